"""Snapshots, overlays and as-of lookups as joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by the given total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").drop("nth_")


def manifest(overlays: DataFrame, key: str) -> DataFrame:
    """Rows of a snapshot chain that are visible: per key the row of least depth, unless it deletes."""
    return latest(overlays, [key], ["depth"]).where(F.col("op") != "delete")


def diff(base: DataFrame, target: DataFrame, key: str, value: str) -> DataFrame:
    """(key, op): add, modify or delete turns base into target."""
    b, t = base.select(F.col(key), F.col(value).alias("old"), F.lit(True).alias("in_b")), target.select(F.col(key), F.col(value).alias("new"), F.lit(True).alias("in_t"))
    op = F.when(F.col("in_b").isNull(), "add").when(F.col("in_t").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "modify")
    return b.join(t, key, "full_outer").select(key, op.alias("op")).where("op is not null")


def apply_diff(base: DataFrame, changes: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """base without changed keys, and the target's rows of added and modified keys."""
    kept = base.join(changes.select(key), key, "left_anti")
    new = target.join(changes.where(F.col("op") != "delete").select(key), key, "left_semi")
    return kept.unionByName(new)


def as_of(events: DataFrame, spans: DataFrame, key: str, at: str, since: str) -> DataFrame:
    """Each event with the span of its key that began last at or before it, by one merge of both tables per key: no
    event meets more than one span, whatever the number of spans."""
    e = events.withColumn("t_", F.col(at)).withColumn("kind_", F.lit(1)).withColumn("span_", F.lit(None).cast(spans.schema["span_id"].dataType))
    s = spans.select(F.col(key), F.col(since).alias("t_"), F.lit(0).alias("kind_"), F.col("span_id").alias("span_"))
    w = Window.partitionBy(key).orderBy("t_", "kind_", F.col("span_").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = e.unionByName(s, allowMissingColumns=True).withColumn("found_", F.last("span_", ignorenulls=True).over(w))
    return both.where("kind_ = 1").drop("t_", "kind_", "span_").withColumnRenamed("found_", "span_id")


def innermost(points: DataFrame, spans: DataFrame, bucket: str) -> DataFrame:
    """Each point (bucket, point_id, line) with the smallest span (bucket, span_id, start_line, end_line) around it."""
    hits = points.join(spans, bucket).where("line between start_line and end_line")
    return hits.groupBy("point_id").agg(F.min_by("span_id", F.struct((F.col("end_line") - F.col("start_line")).alias("len"), F.col("span_id").alias("id"))).alias("span_id"))
