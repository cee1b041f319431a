"""Writing results: once, as lines, as an index, or into a cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumark.functions.text import tokens
from vellumark.tables import exists


def write_once(df: DataFrame, path: str, kind: str = "parquet", **options: str) -> None:
    """Writes a table where nothing is yet; a path that exists is an error. A failed job leaves no finished table."""
    df.write.mode("errorifexists").options(**options).format(kind).save(path)


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines."""
    write_once(df, path, "json")


def write_report(df: DataFrame, path: str) -> None:
    """One CSV file with a header; for small tables."""
    write_once(df.coalesce(1), path, "csv", header="true")


def write_index(docs: DataFrame, doc: str, fields: dict[str, str], path: str, buckets: int = 64) -> None:
    """A search index of three tables: postings (by token's bucket), documents with their lengths, and the collection's figures.

    Postings are partitioned by the token's hash bucket, so a search (operators.retrieval.search_index) reads only its tokens' buckets.
    """
    tf = None
    for name, column in fields.items():
        one = docs.select(F.col(doc).alias("doc"), F.explode(tokens(column)).alias("token")).groupBy("doc", "token").agg(F.count(F.lit(1)).alias("tf")).withColumn("field", F.lit(name))
        tf = one if tf is None else tf.unionByName(one)
    bucketed = tf.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
    bucketed.repartition("bucket").sortWithinPartitions("token", "doc").write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/postings")
    lengths = docs.select(F.col(doc).alias("doc"), *(F.size(tokens(c)).alias("length_" + n) for n, c in fields.items()))
    write_once(lengths, f"{path}/documents")
    write_once(docs.agg(F.count(F.lit(1)).alias("n"), F.lit(buckets).alias("buckets"), *(F.avg(F.size(tokens(c))).alias("mean_" + n) for n, c in fields.items())), f"{path}/figures")


def fill_cache(wanted: DataFrame, key: str, cache_path: str, compute) -> DataFrame:
    """The rows of `wanted` with their cached values; missing ones are computed once per key, and appended.

    compute takes the rows without a value, one per key, and returns (key, value). Calling it again computes nothing new.
    """
    spark = wanted.sparkSession
    cache = spark.read.parquet(cache_path) if exists(spark, cache_path) else None
    need = wanted.where(F.col(key).isNotNull()).dropDuplicates([key])
    if cache is not None:
        need = need.join(cache.select(key), key, "left_anti")
    compute(need).write.mode("append").parquet(cache_path)
    return wanted.join(spark.read.parquet(cache_path).dropDuplicates([key]), key, "left")
