"""Streams: windowed counts with late data, replays dropped, and claims checked against a fixed index as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumark.functions.text import tokens
from vellumark.tables import exists


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) per window of event time. In append mode a window comes out once the watermark has passed it, its state
    goes, and later rows are dropped; in complete mode all windows stay and nothing is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = timed.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def without_replays(events: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark, so state stays bounded."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def score_claims(claims: DataFrame, weights: DataFrame) -> DataFrame:
    """(claim_id, doc, part): a stream of claims joined with a fixed table (token, doc, weight) of term weights, one row per shared token."""
    asked = claims.select("claim_id", F.explode(F.array_distinct(tokens("claim_text"))).alias("token"))
    return asked.join(weights, "token").select("claim_id", "doc", F.col("weight").alias("part"))


def upsert_into(path: str, key: str):
    """A foreachBatch function that appends rows whose key the table at `path` lacks, so a replayed batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        if exists(spark, path):
            new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
        new.write.mode("append").parquet(path)

    return write


def run_to_end(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns the table it made under `folder`.

    Each batch overwrites its own part, so a batch that runs again after a failure changes nothing. In mode "complete" a batch holds the
    whole result and the last one counts.
    """
    last = [0]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        last[0] = max(last[0], number)

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    made = stream.sparkSession.read.schema(stream.schema)
    return made.parquet(f"{folder}/out/batch={last[0]}" if mode == "complete" else f"{folder}/out/*")
