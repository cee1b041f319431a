"""Queries over streams and over the engine's own files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumark.plans.registry import Register
from vellumark.streaming import flows
from vellumark.tables import load, scratch

query = Register()


def _folder(spark: SparkSession) -> str:
    return scratch(spark, "stream")


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    schema = load(spark, sf_dir, table).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}*").parquet(sf_dir)


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type, counted as a stream to its end."""
    counts = flows.event_counts(_stream(spark, sf_dir, "events"))
    return flows.run_to_end(counts, _folder(spark), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("SELECT user_id, min(event_id) AS first_event FROM events GROUP BY user_id")
def stream_first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event id of every user, as a stateful aggregation over a stream."""
    s = _stream(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("first_event"))
    return flows.run_to_end(s, _folder(spark), "complete")


QUERIES, SQL = query.queries, query.sql
