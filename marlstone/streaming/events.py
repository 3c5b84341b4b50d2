"""Stateful streams: facts that wait for their endpoint, windows over event time, and indexing of arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.streaming.tables import drain


def pending_edges(edges: DataFrame, endpoints: DataFrame, key: str, folder: str) -> DataFrame:
    """Edges come out once their endpoint has appeared, whichever arrives first.

    Both sides wait in Spark's state store, dealt out by key; an endpoint that appears again releases nothing twice.
    """
    return drain(edges.join(endpoints.dropDuplicates([key]), key), folder)


def tumbling(events: DataFrame, width: str, late: str, folder: str, *keys: str) -> DataFrame:
    """(keys, window_start, n, total) of each window of event time.

    Windows that are still open at the end are told too: each batch writes the whole window table to a folder of its
    own, whose rows are as many as windows and keys, and the last one is read.
    """
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    counts = counts.select(*keys, F.col("window.start").alias("window_start"), "n", "total")
    batches = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/windows/{number}")
        batches.append(number)

    drain(counts, folder, write, "complete")
    spark = events.sparkSession
    return spark.read.schema(counts.schema).parquet(f"{folder}/windows/{max(batches)}") if batches else spark.createDataFrame([], counts.schema)


def first_seen(events: DataFrame, key: str, late: str, folder: str) -> DataFrame:
    """Each key once, within the watermark."""
    return drain(events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]), folder)


def indexed(files: DataFrame, folder: str) -> DataFrame:
    """What arriving files hold: content hash, lines and bytes of each text, row by row and without a shuffle."""
    text = F.coalesce("text", F.lit(""))
    facts = files.select("doc_id", F.sha2(text.cast("binary"), 256).alias("content_hash"), F.size(F.split(text, "\n")).cast("long").alias("lines"), F.octet_length(text).cast("long").alias("bytes"))
    return drain(facts, folder)
