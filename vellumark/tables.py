"""Reading the tables, cutting lineage through a shared folder, and joins that survive hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[int, str] = {}
_OWN: dict[str, SparkSession] = {}


def load(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """One table of a data folder; with names, only those columns are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a session that runs in one process takes a temporary
    folder of its own; on a cluster it is an error, because executors couldn't read it."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir is not set: {master} needs a folder that all executors share")
    key = id(spark.sparkContext)
    if key not in _LOCAL:
        _LOCAL[key] = "file://" + tempfile.mkdtemp(prefix="vellumark-")
        spark.sparkContext.setCheckpointDir(_LOCAL[key])
    return _LOCAL[key]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except (Py4JError, OSError, AttributeError):  # the session may be gone; a leftover file is no error
        pass


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


@atexit.register
def _remove_all() -> None:
    for path, spark in list(_OWN.items()):
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)
    for folder in _LOCAL.values():
        shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the process ends."""
    path = f"{shared_dir(spark)}/vellumark/{name}-{uuid.uuid4().hex}"
    _OWN[path] = spark
    return path


class Cut:
    """A table written to the shared folder and read back: its lineage is one scan, and its size is known to the planner."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/vellumark/{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        _OWN[self.path] = self.spark
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Frees the files; no frame that still reads them may be used after this."""
        if _OWN.pop(self.path, None):
            _remove(self.spark, self.path)


def cut(df: DataFrame) -> DataFrame:
    """df behind a written table that lives until the process ends."""
    return Cut(df).df


#: A key with fewer rows than this is never treated as hot.
HOT_ROWS = 10_000


def hot_keys(df: DataFrame, key: str, share: int = 256, rows: int | None = None) -> list:
    """Keys that hold more than one in `share` of all rows (and over HOT_ROWS): fewer than `share` values, whatever the size of df."""
    total = df.count() if rows is None else rows
    if total <= HOT_ROWS:
        return []
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return [r[0] for r in counts.where(F.col("_n") > max(HOT_ROWS, total // share)).select(key).collect()]


def join_on_unique(many: DataFrame, one: DataFrame, key: str, how: str = "inner", salts: int = 32, rows: int | None = None, hot: list | None = None) -> DataFrame:
    """Joins rows to a side that has each key once; rows of hot keys are spread over `salts` copies of that key's row.

    The salt is a hash of the row, so a task that runs again sends each row where it went before. Rows with a null key find
    no partner. `one` is never broadcast by a hint. rows: the row count of `many` where it is known; hot: its hot keys where they are.
    """
    hot = hot_keys(many, key, rows=rows) if hot is None else hot
    if not hot:
        return many.join(one, key, how)
    is_hot = F.col(key).isin(hot)
    left = many.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*many.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    right = one.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def fingerprint(df: DataFrame, *cols: str) -> tuple[int, int]:
    """Row count and an order-free sum of row hashes: equal for equal bags of rows."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("h")).first()
    return int(r["n"]), int(r["h"] or 0)


def words(text: Column | str) -> Column:
    """Runs of letters and digits in lower case, in order; null text gives an empty list."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
