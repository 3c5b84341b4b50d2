"""Folders of Markdown and canvas files as tables, and canvases checked and turned into Markdown.

Files are read by Spark's binary source, folder by folder; a folder's fingerprint is added up from a hash of each file's path and
content, so that no order is needed and nothing is gathered. Canvases are parsed by from_json; one that breaks a rule is a row with its error.

Defined cases: a folder without such files gives no row and the fingerprint of nothing; texts that are no UTF-8 have
replacement characters; nodes without id or type, and edges without id, have those of their place; null texts are no JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "struct<id:string,type:string,file:string,text:string,url:string,x:double,y:double,width:double,height:double>"
EDGE = "struct<id:string,fromNode:string,toNode:string,label:string>"


def read_markdown_dir(spark: SparkSession, location: str) -> DataFrame:
    """(file_path, content_hash, byte_size, text) of the md, markdown and canvas files below a folder, in whatever depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mMcC][dDaA]*").load(location)
    # an input has its own form of the folder's name, as file:///x for /x
    root = F.lit(location.rstrip("/").removeprefix("file:").lstrip("/") + "/")
    below = F.split_part(F.col("path"), root, F.lit(-1))
    return files.where(F.lower("path").rlike(r"\.(md|markdown|canvas)$")).select(below.alias("file_path"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("byte_size"), F.decode("content", "UTF-8").alias("text"))


def fingerprint(files: DataFrame) -> DataFrame:
    """One row (files, fingerprint) of files (file_path, content_hash): alike for the same paths with the same content, in any order."""
    each = F.sha2(F.concat_ws("\x00", "file_path", "content_hash"), 256)
    part = lambda k: F.conv(F.substring(each, 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")
    sums = files.agg(F.count("*").alias("files"), *[F.coalesce(F.sum(part(k)), F.lit(0)).cast("string").alias(f"s{k}") for k in range(4)])
    return sums.select("files", F.sha2(F.concat_ws(",", "files", "s0", "s1", "s2", "s3"), 256).alias("fingerprint"))


def canvases(files: DataFrame) -> DataFrame:
    """(file_path, error, nodes, edges, markdown) of canvas files (file_path, text). error is CANVAS_INVALID_JSON,
    CANVAS_INVALID_DOCUMENT, CANVAS_INVALID_NODE:n, CANVAS_INVALID_EDGE:n or CANVAS_EDGE_NODE_NOT_FOUND:n, the first that applies."""
    whole = F.try_parse_json("text")
    parts = lambda name: F.try_variant_get(whole, f"$.{name}", "array<variant>")
    object_ = lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    at = lambda v, key: F.try_variant_get(v, f"$.{key}", "string")
    number = lambda v, key, default: F.coalesce(F.try_variant_get(v, f"$.{key}", "double"), F.lit(float(default))).alias(key)
    named = lambda v, i, prefix: F.coalesce(F.nullif(at(v, "id"), F.lit("")), F.concat(F.lit(prefix), (i + 1).cast("string"))).alias("id")
    node = lambda v, i: F.struct(named(v, i, "node-"), F.coalesce(F.nullif(at(v, "type"), F.lit("")), F.lit("text")).alias("type"), *[at(v, k).alias(k) for k in ("file", "text", "url")], number(v, "x", 0), number(v, "y", 0), number(v, "width", 200), number(v, "height", 100))
    edge = lambda v, i: F.struct(named(v, i, "edge-"), *[F.coalesce(at(v, k), F.lit("")).alias(k) for k in ("fromNode", "toNode")], at(v, "label").alias("label"))
    read = files.select("file_path", whole.alias("whole"), parts("nodes").alias("raw_nodes"), parts("edges").alias("raw_edges"))
    read = read.select("file_path", "whole", "raw_nodes", "raw_edges", F.transform("raw_nodes", node).cast(f"array<{NODE}>").alias("nodes"), F.transform("raw_edges", edge).cast(f"array<{EDGE}>").alias("edges"))
    first = lambda values, bad: F.array_position(F.transform(values, lambda v: F.coalesce(bad(v), F.lit(True)).cast("int")), 1) - 1
    ids = F.transform("nodes", lambda n: n["id"])
    bad_node, bad_edge = first("raw_nodes", lambda v: ~object_(v)), first("raw_edges", lambda v: ~object_(v))
    lost = first("edges", lambda e: ~(F.array_contains(ids, e["fromNode"]) & F.array_contains(ids, e["toNode"])))
    # edges are looked at one after the other, each for both
    wrong = F.when((bad_edge >= 0) & ((lost < 0) | (bad_edge <= lost)), F.concat(F.lit("CANVAS_INVALID_EDGE:"), bad_edge.cast("string"))).when(lost >= 0, F.concat(F.lit("CANVAS_EDGE_NODE_NOT_FOUND:"), lost.cast("string")))
    error = F.when(F.col("whole").isNull(), "CANVAS_INVALID_JSON").when(F.col("raw_nodes").isNull() | F.col("raw_edges").isNull(), "CANVAS_INVALID_DOCUMENT").when(bad_node >= 0, F.concat(F.lit("CANVAS_INVALID_NODE:"), bad_node.cast("string"))).otherwise(wrong)
    line = F.transform("nodes", lambda n: F.when((n["type"] == "file") & n["file"].isNotNull(), F.concat(F.lit("[["), n["file"], F.lit("]]"))).when(n["text"].isNotNull(), n["text"]).when((n["type"] == "link") & n["url"].isNotNull(), n["url"]))
    labels = F.filter(F.transform("edges", lambda e: F.nullif(e["label"], F.lit(""))), lambda x: x.isNotNull())
    name = F.substring_index("file_path", "/", -1)
    head = F.array(F.lit("---"), F.concat(F.lit("id: canvas:"), name), F.concat(F.lit("title: "), F.regexp_replace(name, r"(?i)\.canvas$", "")), F.lit("type: canvas"), F.lit("---"), F.lit(""))
    markdown = F.concat(F.array_join(F.concat(head, F.array_compact(line), labels), "\n"), F.lit("\n"))
    good = lambda c: F.when(F.col("error").isNull(), c)
    return read.withColumn("error", error).select("file_path", "error", good(F.col("nodes")).alias("nodes"), good(F.col("edges")).alias("edges"), good(markdown).alias("markdown"))
