"""The append-only ledger, materialised batch by batch.

Only a gapless run of sequence numbers is applied: rows at or under the last applied number are skipped, repeated rows
count once, and a gap fails the batch before anything of it is written. Every batch overwrites a folder of its own, so
that a batch that runs again leaves the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.streaming.tables import drain

POSITION = "last long, batch long"


class LedgerGap(ValueError):
    """The next sequence number is not there."""


def event_key(*columns: str) -> Column:
    """Identity of an event, the same in every replay."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256), 1, 24)


def last_applied(spark: SparkSession, folder: str, before: int) -> int:
    """Last number that the batches before this one applied; one small row a batch."""
    return spark.read.schema(POSITION).parquet(f"{folder}/position").where(F.col("batch") < before).agg(F.max("last")).first()[0]


def mark(spark: SparkSession, folder: str, batch: int, last: int) -> None:
    spark.createDataFrame([(last, batch)], POSITION).coalesce(1).write.mode("overwrite").parquet(f"{folder}/position/run={batch}")


def materialise(ledger: DataFrame, folder: str, first: int = 1) -> DataFrame:
    """Apply a stream with a column seq and return all rows applied so far."""
    spark = ledger.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        last = last_applied(session, folder, number)
        fresh = batch.where(F.col("seq") > last).dropDuplicates(["seq"])
        n, low, high = fresh.agg(F.count("*"), F.min("seq"), F.max("seq")).first()
        if n and (low != last + 1 or high - low + 1 != n):
            raise LedgerGap(f"LedgerGap: after {last} there are {n} rows from {low} to {high}")
        fresh.write.mode("overwrite").parquet(f"{folder}/applied/run={number}")
        mark(session, folder, number, high if n else last)

    mark(spark, folder, -1, first - 1)
    drain(ledger, folder, apply)
    return spark.read.schema(ledger.schema).parquet(f"{folder}/applied").select(*ledger.columns)
