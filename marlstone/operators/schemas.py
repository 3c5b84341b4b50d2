"""Completeness of remote methods' schemas: a walk of nested messages, a level a round for all methods at once.

Messages are rows of fields; a method begins with its request and its response. Each round joins the messages that were reached with
their fields and goes on with fields that are messages. A field whose message already stands above it on its own path is marked as a
cycle and not entered, so a walk ends after as many rounds as messages nest.

Defined cases: a null or unknown message is an empty schema at the top and a leaf below; a message without fields is empty;
repeated field rows count once; fields of a null name are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import Rounds


def schema_fields(methods: DataFrame, fields: DataFrame) -> DataFrame:
    """(method, side, path, message, field, type, kind, presence, enum_values, map_value, depth, cycle): every field reached from
    methods (method, request, response) over fields (message, field, type, kind, presence, enum_values, map_value); kind is
    scalar, enum, message or map, whose map_value may name a message."""
    tables = Rounds(methods.sparkSession, "schemas")
    known = tables.keep(fields.where("message is not null and field is not null").dropDuplicates(["message", "field"]))
    tops = [methods.select("method", F.lit(side).alias("side"), F.lit(side).alias("at"), F.col(side).alias("message")) for side in ("request", "response")]
    front = tops[0].unionByName(tops[1]).withColumn("above", F.array("message"))
    out, depth = None, 0
    while True:
        depth += 1
        inner = F.when(F.col("kind") == "message", F.col("type")).when(F.col("kind") == "map", F.col("map_value"))
        step = front.join(known, "message").withColumns({"path": F.concat("at", F.lit("."), "field"), "inner": inner, "depth": F.lit(depth)})
        step = tables.keep(step.withColumn("cycle", F.coalesce(F.array_contains("above", F.col("inner")), F.lit(False))))
        shown = step.select("method", "side", "path", "message", "field", "type", "kind", "presence", "enum_values", "map_value", "depth", "cycle")
        out = shown if out is None else out.unionByName(shown)
        front = step.where("inner is not null and not cycle").select("method", "side", F.col("path").alias("at"), F.col("inner").alias("message"), F.array_append("above", F.col("inner")).alias("above"))
        if not front.join(known, "message", "left_semi").limit(1).count():
            return out


def schema_gaps(methods: DataFrame, fields: DataFrame) -> DataFrame:
    """(method, code, path): request_schema_empty, response_schema_empty, map_value_type_missing, enum_values_missing and presence_unknown."""
    walked = schema_fields(methods, fields)
    sides = methods.select("method", F.explode(F.array(F.lit("request"), F.lit("response"))).alias("side"))
    empty = sides.join(walked.where("depth = 1").select("method", "side").distinct(), ["method", "side"], "left_anti").select("method", F.concat("side", F.lit("_schema_empty")).alias("code"), F.col("side").alias("path"))
    codes = F.array_compact(
        F.array(
            F.when((F.col("kind") == "map") & F.col("map_value").isNull(), "map_value_type_missing"),
            F.when((F.col("kind") == "enum") & (F.coalesce(F.size("enum_values"), F.lit(0)) == 0), "enum_values_missing"),
            F.when(F.col("presence").isNull(), "presence_unknown"),
        )
    )
    return empty.unionByName(walked.select("method", F.explode(codes).alias("code"), "path"))
