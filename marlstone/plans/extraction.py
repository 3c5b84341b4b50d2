"""Extraction queries. The driver's prose has no code, so the code facts come from lines made of table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import extract as E
from marlstone.plans.base import query, table
from marlstone.sources.views import FILES_SQL, files

# a line of code for each part, with one fact of each kind
CODE_SQL = """code AS (SELECT p_partkey AS doc_id, 'function f' || p_size || '() { if (x) throw new E' || (p_partkey % 7) || '(); logger.info("made ' || p_brand || '"); bus.emit("t' || (p_partkey % 5) || '"); return process.env.K_' || p_size || ' }'
 || chr(10) || 'import { a } from "./m' || (p_partkey % 9) || '" // [[' || p_name || '#x|y]] #tag' || (p_partkey % 4) || chr(10) || '@Get("/p") rpc Call' || (p_partkey % 3) || ' (R)' AS text FROM part)"""


def code(spark, sf_dir):
    k, s = F.col("p_partkey"), lambda c: c.cast("string")
    text = F.concat(
        F.lit("function f"), s(F.col("p_size")), F.lit("() { if (x) throw new E"), s(k % 7), F.lit('(); logger.info("made '), "p_brand", F.lit('"); bus.emit("t'), s(k % 5), F.lit('"); return process.env.K_'), s(F.col("p_size")), F.lit(" }"),
        F.lit('\nimport { a } from "./m'), s(k % 9), F.lit('" // [['), "p_name", F.lit("#x|y]] #tag"), s(k % 4), F.lit('\n@Get("/p") rpc Call'), s(k % 3), F.lit(" (R)"),
    )
    return table(spark, sf_dir, "part").select(k.alias("doc_id"), text.alias("text"))


def facts_sql(*kinds: str) -> str:
    body = " UNION ALL ".join("SELECT doc_id, n::BIGINT AS line_number, '{k}' AS kind, unnest(regexp_extract_all(line, '{p}', 1)) AS value FROM e".format(k=k, p=E.PATTERNS[k].replace("'", "''")) for k in kinds)
    return f"WITH {CODE_SQL}, l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM code), e AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS n FROM l) {body}"


@query(facts_sql("log_site"))
def ext_log_sites(spark, sf_dir):
    return E.facts(code(spark, sf_dir), ["log_site"])


@query(facts_sql("throws", "env"))
def ext_code_entities(spark, sf_dir):
    return E.facts(code(spark, sf_dir), ["throws", "env"])


@query(facts_sql("endpoint", "rpc"))
def ext_endpoints(spark, sf_dir):
    return E.facts(code(spark, sf_dir), ["endpoint", "rpc"])


@query(facts_sql("publishes", "subscribes"))
def ext_channels(spark, sf_dir):
    return E.facts(code(spark, sf_dir), ["publishes", "subscribes"])


@query(facts_sql("wikilink", "tag"))
def ext_md_links(spark, sf_dir):
    return E.facts(code(spark, sf_dir), ["wikilink", "tag"])


@query("""
WITH refs AS (SELECT l_orderkey * 10 + l_linenumber AS ref_id, l_suppkey AS doc_id, l_quantity::BIGINT AS name FROM lineitem), symbols AS (SELECT s_suppkey AS doc_id, s_suppkey % 60 AS name FROM supplier),
t AS (SELECT name, count(*) AS n FROM symbols GROUP BY name)
SELECT ref_id, CASE WHEN o.doc_id IS NOT NULL THEN 'same_file' WHEN n = 1 THEN 'unique' WHEN n <= 6 THEN 'candidates' ELSE 'unresolved' END AS tier, coalesce(n, 0)::BIGINT AS candidates
FROM refs r LEFT JOIN (SELECT DISTINCT doc_id, name FROM symbols) o ON r.doc_id = o.doc_id AND r.name = o.name LEFT JOIN t ON r.name = t.name""")
def ext_resolve_refs(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"), F.col("l_suppkey").alias("doc_id"), F.col("l_quantity").cast("long").alias("name"))
    return E.resolve_refs(refs, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), (F.col("s_suppkey") % 60).alias("name")))


@query("""
WITH h AS (SELECT sha256(text) AS h, source, doc_id FROM documents), c AS (SELECT h, sum((source < 'src14')::INT) AS a, sum((source >= 'src14')::INT) AS b FROM h GROUP BY h)
SELECT h AS body_hash, CASE WHEN a = 1 AND b = 1 THEN 'alias' ELSE 'suggestion' END AS outcome FROM c WHERE a >= 1 AND b >= 1""")
def ext_renames(spark, sf_dir):
    """Equal bodies on both sides: one to one is a rename, else a suggestion."""
    a = (F.col("source") < "src14").cast("long")
    c = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("body_hash")).agg(F.sum(a).alias("a"), F.sum(1 - a).alias("b"))
    return c.where("a >= 1 and b >= 1").select("body_hash", F.when((F.col("a") == 1) & (F.col("b") == 1), "alias").otherwise("suggestion").alias("outcome"))


@query(r"""SELECT DISTINCT kind, value FROM (SELECT 'ipv4' AS kind, unnest(regexp_extract_all(text, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b')) AS value FROM documents
UNION ALL SELECT 'aws_key', unnest(regexp_extract_all(text, 'AKIA[0-9A-Z]{16}')) FROM documents)""")
def ext_entities(spark, sf_dir):
    """Entities of documents, once each."""
    d = table(spark, sf_dir, "documents")
    find = lambda kind, p: d.select(F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("value"))
    return find("ipv4", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b").unionAll(find("aws_key", "AKIA[0-9A-Z]{16}")).distinct()


@query("SELECT doc_id, (CASE WHEN length(text) = 0 THEN 0 ELSE len(range(1, greatest(length(text) - 180, 1) + 1, 1020)) END)::BIGINT AS n_chunks FROM documents")
def semantic_chunk(spark, sf_dir):
    """Windows of 1200 characters that overlap by 180."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(E.chunks(F.col("text"), 1200, 180)).cast("long").alias("n_chunks"))


@query(f"WITH {FILES_SQL}, l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM files) SELECT doc_id, len(parts)::BIGINT AS n_lines, list_max(list_transform(parts, lambda x: length(x)))::BIGINT AS longest FROM l")
def ext_line_index(spark, sf_dir):
    parts = F.split("text", "\n")
    return files(spark, sf_dir).select("doc_id", F.size(parts).cast("long").alias("n_lines"), F.array_max(F.transform(parts, lambda x: F.char_length(x))).cast("long").alias("longest"))


@query("SELECT event_id, key AS property_key, CASE WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 'number' WHEN v IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date' ELSE 'string' END AS value_type FROM (SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.k') AS v FROM events)")
def ext_md_properties(spark, sf_dir):
    """Typed properties, one row each."""
    e = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("property_key", "v"))
    kind = F.when(F.expr("try_cast(v as double)").isNotNull(), "number").when(F.col("v").isin("true", "false"), "boolean").when(F.col("v").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "date").otherwise("string")
    return e.select("event_id", "property_key", kind.alias("value_type"))
