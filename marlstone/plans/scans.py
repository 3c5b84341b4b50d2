"""Source and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.plans.base import query, table
from marlstone.sources.views import FILES_SQL, files


@query(f"WITH {FILES_SQL} SELECT doc_id, (length(text) >= 3000 AND length(text) / (length(text) - length(replace(text, chr(10), '')) + 1) > 300) AS minified FROM files")
def scan_minified(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", X.minified(F.col("text")).alias("minified"))


PATHS_SQL = "paths AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'src/' || source || '/mod' || doc_id || '.ts' WHEN 1 THEN 'docs/' || doc_id || '.md' WHEN 2 THEN 'node_modules/' || source || '/x.js' WHEN 3 THEN source || '/.env' WHEN 4 THEN 'dist/' || doc_id || '.min.js' ELSE source || '/conf.yaml' END AS path FROM documents)"


def paths(spark, sf_dir):
    d, i, s = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string"), F.col("source")
    k = F.col("doc_id") % 6
    p = F.when(k == 0, F.concat(F.lit("src/"), s, F.lit("/mod"), i, F.lit(".ts"))).when(k == 1, F.concat(F.lit("docs/"), i, F.lit(".md"))).when(k == 2, F.concat(F.lit("node_modules/"), s, F.lit("/x.js")))
    return d.select("doc_id", p.when(k == 3, F.concat(s, F.lit("/.env"))).when(k == 4, F.concat(F.lit("dist/"), i, F.lit(".min.js"))).otherwise(F.concat(s, F.lit("/conf.yaml"))).alias("path"))


_CLASS = " ".join(f"WHEN regexp_matches(path, '{p}') THEN '{n}'" for n, p in X.PATH_CLASSES)


@query(f"WITH {PATHS_SQL} SELECT doc_id, CASE {_CLASS} ELSE 'source' END AS class FROM paths")
def scan_path_class(spark, sf_dir):
    return paths(spark, sf_dir).select("doc_id", X.path_class(F.col("path")).alias("class"))


_LANG = " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in X.LANGUAGES.items())


@query(f"WITH {PATHS_SQL} SELECT doc_id, CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) {_LANG} END AS language FROM paths")
def scan_language(spark, sf_dir):
    return paths(spark, sf_dir).select("doc_id", X.language(F.col("path")).alias("language"))


@query(f"WITH {PATHS_SQL} SELECT doc_id FROM paths WHERE NOT regexp_matches(path, '(^|/)(node_modules|dist)/') AND NOT regexp_matches(path, '\\.min\\.')")
def scan_walk_filter(spark, sf_dir):
    p = F.col("path")
    return paths(spark, sf_dir).where(~p.rlike(r"(^|/)(node_modules|dist)/") & ~p.rlike(r"\.min\.")).select("doc_id")


@query(f"WITH {PATHS_SQL}, c AS (SELECT doc_id, CASE {_CLASS} ELSE 'source' END AS class FROM paths) SELECT doc_id FROM c WHERE class NOT IN ('generated', 'vendor')")
def filter_generated_vendor(spark, sf_dir):
    return paths(spark, sf_dir).where(~X.path_class(F.col("path")).isin("generated", "vendor")).select("doc_id")


@query(f"WITH {FILES_SQL} SELECT doc_id, sha256(text) AS content_hash, strlen(text)::BIGINT AS byte_size FROM files")
def scan_hash(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("byte_size"))


@query(f"WITH {FILES_SQL} SELECT doc_id, CASE WHEN contains(text, chr(0)) THEN 'binary' WHEN strlen(text) > 1000000 THEN 'size_cap' ELSE 'admitted' END AS status, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS line_count FROM files")
def scan_text_class(spark, sf_dir):
    t = F.col("text")
    status = F.when(F.contains(t, F.lit("\0")), "binary").when(F.octet_length(t) > 1_000_000, "size_cap").otherwise("admitted")
    return files(spark, sf_dir).select("doc_id", status.alias("status"), (F.char_length(t) - F.char_length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("line_count"))


def _html_sql() -> str:
    out = "html"
    for pattern, by in X.HTML_RULES:
        flags = pattern[2 : pattern.index(")")] if pattern.startswith("(?") else ""
        body = pattern[pattern.index(")") + 1 :] if flags else pattern
        body, rep = body.replace("'", "''"), by.replace("$1", "\\1").replace("$2", "\\2")
        rep = "'" + rep + "'" if "\n" not in rep else "chr(10)" + (f" || '{rep[1:]}'" if len(rep) > 1 else "")
        out = f"regexp_replace({out}, '{body.replace(chr(10), '')}', {rep}, 'g{flags}')"
    return f"trim({out})"


@query(f"SELECT page_id, sha256({_html_sql()}) AS text_hash, length({_html_sql()})::BIGINT AS n_chars FROM pages")
def scan_url_html(spark, sf_dir):
    """Pages as text."""
    t = table(spark, sf_dir, "pages").select("page_id", X.html_text(F.col("html")).alias("t"))
    return t.select("page_id", F.sha2("t", 256).alias("text_hash"), F.char_length("t").cast("long").alias("n_chars"))


@query("SELECT page_id, (starts_with(url, 'https://') AND NOT contains(url, '@')) AS allowed, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages")
def workspace_guard(spark, sf_dir):
    """HTTPS without credentials only, and the host."""
    return table(spark, sf_dir, "pages").select("page_id", (F.startswith("url", F.lit("https://")) & ~F.contains("url", F.lit("@"))).alias("allowed"), F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("host"))


@query("""
WITH bad AS (SELECT user_id, min(event_id) AS first_bad FROM events WHERE json_extract_string(props, '$.k') IS NULL OR value < 0.5 GROUP BY user_id)
SELECT e.event_id FROM events e LEFT JOIN bad b ON e.user_id = b.user_id WHERE first_bad IS NULL OR event_id < first_bad""")
def scan_jsonl_ledger(spark, sf_dir):
    """The longest valid prefix of each user's ledger."""
    e = table(spark, sf_dir, "events")
    bad = e.where(F.get_json_object("props", "$.k").isNull() | (F.col("value") < 0.5)).groupBy("user_id").agg(F.min("event_id").alias("first_bad"))
    return e.join(bad, "user_id", "left").where("first_bad is null or event_id < first_bad").select("event_id")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def scan_history(spark, sf_dir):
    """The newest 500 rows."""
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", "event_type")


@query(f"WITH {FILES_SQL} SELECT doc_id FROM files WHERE file_path = 'en/src1' OR starts_with(file_path, 'en/src1/')")
def filter_path_prefix(spark, sf_dir):
    p = F.col("file_path")
    return files(spark, sf_dir).where((p == "en/src1") | F.startswith(p, F.lit("en/src1/"))).select("doc_id")


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'purchase')")
def filter_kind(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "purchase")).select("event_id")


@query("SELECT doc_id FROM documents WHERE lang IN ('de', 'fr')")
def filter_languages(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("lang").isin("de", "fr")).select("doc_id")


@query("SELECT doc_id FROM labels WHERE coalesce(toxic, 0) = 0 AND quality = 1")
def filter_sensitive(spark, sf_dir):
    return table(spark, sf_dir, "labels").where((F.coalesce("toxic", F.lit(0)) == 0) & (F.col("quality") == 1)).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderpriority IS NULL")
def filter_branch_scope(spark, sf_dir):
    return table(spark, sf_dir, "orders").where((F.col("o_orderpriority") == "1-URGENT") | F.col("o_orderpriority").isNull()).select("o_orderkey")


@query("SELECT event_id FROM events WHERE lower(event_type) = lower('PURCHASE') AND TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50")
def filter_property(spark, sf_dir):
    """Typed predicates: equality without case, order on numbers only."""
    k = F.expr("try_cast(get_json_object(props, '$.k') as double)")
    return table(spark, sf_dir, "events").where((F.lower("event_type") == "purchase") & (k >= 50)).select("event_id")


@query("SELECT event_id FROM events WHERE contains(lower(event_type || chr(10) || props), 'k\": 7') AND event_type <> 'error'")
def filter_history(spark, sf_dir):
    hay = F.lower(F.concat_ws("\n", "event_type", "props"))
    return table(spark, sf_dir, "events").where(F.contains(hay, F.lit('k": 7')) & (F.col("event_type") != "error")).select("event_id")


@query("SELECT doc_id, length(substr(text, 1, 4000))::BIGINT AS shown, length(text) > 4000 AS truncated FROM documents")
def project_truncate_body(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.char_length(F.substring("text", 1, 4000)).cast("long").alias("shown"), (F.char_length("text") > 4000).alias("truncated"))


def _redact_sql(col: str) -> str:
    for _, pattern, word in X.SECRETS:
        col = f"regexp_replace({col}, '{pattern}', '{word}', 'g')"
    return col


_WHY = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p, _ in X.SECRETS)


@query(f"SELECT doc_id, sha256({_redact_sql('text')}) AS redacted_hash, coalesce(array_to_string(list_filter([{_WHY}], lambda x: x IS NOT NULL), '|'), '') AS reasons FROM documents")
def project_redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.redacted(F.col("text")), 256).alias("redacted_hash"), X.redaction_reasons(F.col("text")).alias("reasons"))


@query("SELECT conv_id, turn, regexp_matches(text, '(?i)\\b(ignore|disregard|system prompt|instructions?)\\b') AS prompt_like FROM conversations")
def project_prompt_like(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").rlike(r"(?i)\b(ignore|disregard|system prompt|instructions?)\b").alias("prompt_like"))


@query("SELECT p_partkey, replace(replace('{{BRAND}}/{{NAME}}/{{OTHER}}', '{{BRAND}}', p_brand), '{{NAME}}', p_name) AS path FROM part")
def project_env_interp(spark, sf_dir):
    """Known variables filled in, unknown ones kept."""
    t = F.replace(F.replace(F.lit("{{BRAND}}/{{NAME}}/{{OTHER}}"), F.lit("{{BRAND}}"), F.col("p_brand")), F.lit("{{NAME}}"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("path"))
