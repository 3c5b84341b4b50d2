"""More queries on stores and texts: decoding, ingestion, exports, ledgers, lifecycles, references in code, notes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions.text import decoded
from marlstone.operators import revisions as R
from marlstone.plans.base import query, table
from marlstone.plans.extraction import CODE_SQL, code
from marlstone.sources.views import read
from marlstone.streaming.tables import new_folder


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, CASE doc_id % 4 WHEN 0 THEN 'utf-16le' WHEN 1 THEN 'utf-16be' WHEN 2 THEN 'utf-8 with mark' ELSE 'utf-8' END AS encoding FROM documents")
def scan_decode(spark, sf_dir):
    """Bytes of four encodings read back as text."""
    text, kind = F.coalesce("text", F.lit("")), F.col("doc_id") % 4
    mark = lambda h: F.unhex(F.lit(h))
    raw = F.when(kind == 0, F.concat(mark("FFFE"), F.encode(text, "UTF-16LE"))).when(kind == 1, F.concat(mark("FEFF"), F.encode(text, "UTF-16BE"))).when(kind == 2, F.concat(mark("EFBBBF"), F.encode(text, "UTF-8"))).otherwise(F.encode(text, "UTF-8"))
    name = F.when(kind == 0, "utf-16le").when(kind == 1, "utf-16be").when(kind == 2, "utf-8 with mark").otherwise("utf-8")
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"), name.alias("encoding")).select("doc_id", F.sha2(decoded(F.col("raw")), 256).alias("content_hash"), "encoding")


@query("SELECT doc_id, substr(sha256('1|' || sha256(coalesce(text, '')) || '|' || CASE WHEN length(text) >= 20 THEN 'ok' ELSE 'short' END), 1, 16) AS fingerprint, CASE WHEN length(text) >= 20 THEN 'admitted' ELSE 'excluded' END AS coverage FROM documents")
def ingest_source(spark, sf_dir):
    """Hash, reason and fingerprint of each file."""
    long = F.length("text") >= 20
    print_ = F.concat(F.lit("1|"), F.sha2(F.coalesce("text", F.lit("")), 256), F.lit("|"), F.when(long, "ok").otherwise("short"))
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(print_, 256), 1, 16).alias("fingerprint"), F.when(long, "admitted").otherwise("excluded").alias("coverage"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'stale' ELSE 'fresh' END AS status FROM documents UNION ALL SELECT doc_id, 'fresh' FROM documents WHERE doc_id % 10 = 0")
def sink_source_fact(spark, sf_dir):
    """A changed content hash makes a new fact and leaves the old one stale."""
    old = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    new = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.coalesce("text", F.lit(""))), 256).alias("new_hash"))
    kept = old.join(new, "doc_id").select("doc_id", F.when(F.col("hash") == F.col("new_hash"), "fresh").otherwise("stale").alias("status"))
    return kept.unionByName(new.join(old, "doc_id").where("hash <> new_hash").select("doc_id", F.lit("fresh").alias("status")))


@query("SELECT o_custkey, o_orderkey, 'old' AS origin FROM orders WHERE o_custkey % 5 <> 0 UNION ALL SELECT o_custkey, o_orderkey, 'new' FROM orders WHERE o_custkey % 5 = 0 AND o_orderstatus = 'O'")
def sink_replace_file_edges(spark, sf_dir):
    """The edges of parsed files are replaced, all others stay."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    new = o.where("o_custkey % 5 = 0 and o_orderstatus = 'O'").select("o_custkey", "o_orderkey", F.lit("new").alias("origin"))
    parsed = o.where("o_custkey % 5 = 0").select("o_custkey").distinct()
    return o.join(parsed, "o_custkey", "left_anti").select("o_custkey", "o_orderkey", F.lit("old").alias("origin")).unionByName(new)


@query("SELECT 'customer' AS name, count(*)::BIGINT AS n FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_nationkey = 7")
def sink_artifact_export(spark, sf_dir):
    """Tables of one repository written out, and the manifest of what was written."""
    folder, out = new_folder(spark, "export"), None
    for name, key in (("customer", "c_nationkey"), ("supplier", "s_nationkey")):
        table(spark, sf_dir, name).where(F.col(key) == 7).write.parquet(f"{folder}/{name}")
        row = spark.read.parquet(f"{folder}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT max(event_id) AS ledger_last, count(*)::BIGINT AS applied, CASE WHEN max(event_id) - min(event_id) + 1 = count(*) THEN 'consistent' ELSE 'gap' END AS status FROM events")
def doctor_consistency(spark, sf_dir):
    dense = F.max("event_id") - F.min("event_id") + 1 == F.count("*")
    return table(spark, sf_dir, "events").agg(F.max("event_id").alias("ledger_last"), F.count("*").alias("applied"), F.when(dense, "consistent").otherwise("gap").alias("status"))


@query("SELECT c_custkey, c_nationkey::BIGINT AS nation FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier) AND c_custkey IN (SELECT o_custkey FROM orders)")
def ontology_link(spark, sf_dir):
    """Links whose ends are both there."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi")
    return c.join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", F.col("c_nationkey").cast("long").alias("nation"))


@query("SELECT event_id, CASE WHEN event_type = 'error' AND (value IS NULL OR value < 10) THEN 'rejected' ELSE 'accepted' END AS outcome FROM events")
def evidence_put(spark, sf_dir):
    """Runtime evidence needs its measurement."""
    bad = (F.col("event_type") == "error") & (F.col("value").isNull() | (F.col("value") < 10))
    return table(spark, sf_dir, "events").select("event_id", F.when(bad, "rejected").otherwise("accepted").alias("outcome"))


@query("SELECT coalesce(c, s)::BIGINT AS nation, CASE WHEN s IS NULL THEN 'left' WHEN c IS NULL THEN 'right' ELSE 'both' END AS side FROM (SELECT DISTINCT c_nationkey AS c FROM customer WHERE c_acctbal > 9000) FULL JOIN (SELECT DISTINCT s_nationkey AS s FROM supplier WHERE s_acctbal > 5000) ON c = s")
def log_targets(spark, sf_dir):
    """Two registries merged by key."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"), F.lit(True).alias("c")).distinct()
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"), F.lit(True).alias("s")).distinct()
    return c.join(s, "nation", "full_outer").select(F.col("nation").cast("long").alias("nation"), F.when(F.col("s").isNull(), "left").when(F.col("c").isNull(), "right").otherwise("both").alias("side"))


@query("SELECT p_brand, p_type, count(*)::BIGINT AS n, CASE WHEN count(*) = 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM part GROUP BY p_brand, p_type")
def api_subjects(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).withColumn("status", F.when(F.col("n") == 1, "unique").otherwise("ambiguous"))


@query("""WITH d AS (SELECT event_id, event_type, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS depth FROM events)
SELECT event_id, depth::BIGINT AS depth, (event_type = 'purchase' AND depth < 0) AS orphan FROM d""")
def api_managed_sections(spark, sf_dir):
    """Begin and end marks counted in order; an end without a begin is an orphan."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.sum(F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)).over(w)
    return table(spark, sf_dir, "events").select("event_id", "event_type", depth.cast("long").alias("depth")).select("event_id", "depth", ((F.col("event_type") == "purchase") & (F.col("depth") < 0)).alias("orphan"))


@query("SELECT CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'success' ELSE 'unknown' END AS class, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def api_response_classes(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "purchase", "success").otherwise("unknown")
    return table(spark, sf_dir, "events").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query("SELECT page_id, length(html)::BIGINT AS total, sha256(substr(html, 1, 500)) AS body_hash, length(html) > 500 AS cut FROM pages")
def response_guard(spark, sf_dir):
    """Bodies cut at a bound, with their whole size."""
    return table(spark, sf_dir, "pages").select("page_id", F.length("html").cast("long").alias("total"), F.sha2(F.substring("html", 1, 500), 256).alias("body_hash"), (F.length("html") > 500).alias("cut"))


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'add' WHEN b.k IS NULL THEN 'delete' ELSE 'modify' END AS op FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 4 <> 0) a FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS v FROM customer WHERE c_custkey % 5 <> 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v")
def vault_diff(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return R.diff(c.where("k % 4 <> 0"), c.where("k % 5 <> 0").withColumn("v", F.when(F.col("k") % 3 == 0, F.col("v") + 1).otherwise(F.col("v"))), "k", "v")


@query("SELECT o_custkey, max(o_orderkey) AS published FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def rev_publish(spark, sf_dir):
    """The newest ready snapshot of each repository."""
    ready = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    return ready.groupBy("o_custkey").agg(F.max("o_orderkey").alias("published"))


@query("SELECT o_orderkey, l_linenumber::BIGINT AS line, p_name AS symbol FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_custkey = 7")
def rev_view_symbols(spark, sf_dir):
    """Symbols that one manifest shows."""
    manifest = table(spark, sf_dir, "orders").where("o_custkey = 7").select("o_orderkey")
    return manifest.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("o_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.col("p_name").alias("symbol"))


@query("""WITH s AS (SELECT unnest(['7', 'ORDER 9', 'nope']) AS selector), m AS (SELECT selector, o_orderkey FROM s LEFT JOIN orders ON selector = o_orderkey::VARCHAR OR lower(selector) = 'order ' || o_orderkey)
SELECT selector, CASE WHEN count(o_orderkey) = 1 THEN 'resolved' WHEN count(o_orderkey) = 0 THEN 'not_found' ELSE 'ambiguous' END AS status, min(o_orderkey) AS snapshot FROM m GROUP BY selector""")
def rev_resolve(spark, sf_dir):
    """Selectors by key or by name."""
    wanted = spark.createDataFrame([("7",), ("ORDER 9",), ("nope",)], "selector string")
    key = F.col("o_orderkey").cast("string")
    named = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array_distinct(F.array(key, F.concat(F.lit("order "), key)))).alias("name"))
    found = F.broadcast(wanted).join(named, F.lower("selector") == F.col("name"), "left").groupBy("selector").agg(F.count("o_orderkey").alias("n"), F.min("o_orderkey").alias("snapshot"))
    return found.select("selector", F.when(F.col("n") == 1, "resolved").when(F.col("n") == 0, "not_found").otherwise("ambiguous").alias("status"), "snapshot")


def _found(df, pattern: str):
    """(doc_id, line_number, value) of every match of the pattern's group."""
    lines = df.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.select("doc_id", (F.col("n") + 1).cast("long").alias("line_number"), F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(1))).alias("value"))


def _found_sql(pattern: str) -> str:
    return f"WITH {CODE_SQL}, l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM code), e AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS n FROM l) SELECT doc_id, n::BIGINT AS line_number, unnest(regexp_extract_all(line, '{pattern}', 1)) AS value FROM e"


CALLS, FIELDS, READS, RPC = r"([A-Za-z_][A-Za-z0-9_.]*)\(", r"\.([a-z]+)\b", r"process\.env\.([A-Z_0-9]+)", r"rpc ([A-Za-z0-9]+)"


@query(_found_sql(CALLS))
def ext_refs(spark, sf_dir):
    return _found(code(spark, sf_dir), CALLS)


@query(_found_sql(FIELDS))
def ext_identifiers(spark, sf_dir):
    return _found(code(spark, sf_dir), FIELDS)


@query(_found_sql(READS))
def ext_field_access(spark, sf_dir):
    return _found(code(spark, sf_dir), READS)


@query(_found_sql(RPC))
def ext_proto(spark, sf_dir):
    return _found(code(spark, sf_dir), RPC)


@query(r"SELECT p_partkey, lower(regexp_replace(regexp_replace(p_type || p_brand, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')) AS lexical FROM part")
def ext_lexical_text(spark, sf_dir):
    opened = F.regexp_replace(F.concat("p_type", "p_brand"), "([a-z0-9])([A-Z])", "$1 $2")
    return table(spark, sf_dir, "part").select("p_partkey", F.lower(F.regexp_replace(opened, "[^A-Za-z0-9]+", " ")).alias("lexical"))


@query(r"SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10))[1] AS title, len(regexp_extract_all(coalesce(text, ''), '#[A-Za-z]+'))::BIGINT AS n_tags FROM conversations")
def ext_note_parse(spark, sf_dir):
    """Title and tags of each note."""
    text = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.get(F.split(text, "\n"), F.lit(0)).alias("title"), F.regexp_count(text, F.lit("#[A-Za-z]+")).cast("long").alias("n_tags"))


@query("""WITH t AS (SELECT DISTINCT c_mktsegment AS target FROM customer UNION SELECT n_name FROM nation UNION SELECT r_name FROM region)
SELECT target, CASE WHEN target IN (SELECT r_name FROM region) THEN 'note' WHEN target IN (SELECT n_name FROM nation) THEN 'symbol' ELSE 'none' END AS resolved_by FROM t""")
def ext_link_resolution(spark, sf_dir):
    """Link targets by the first kind that knows the name."""
    name = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("target")).distinct()
    regions, nations = name("region", "r_name").withColumn("r", F.lit("note")), name("nation", "n_name").withColumn("n", F.lit("symbol"))
    t = name("customer", "c_mktsegment").unionAll(nations.select("target")).unionAll(regions.select("target")).distinct()
    return t.join(regions, "target", "left").join(nations, "target", "left").select("target", F.coalesce("r", "n", F.lit("none")).alias("resolved_by"))


@query("SELECT key AS name, count(*)::BIGINT AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def ext_package_detect(spark, sf_dir):
    """Names that manifests declare."""
    return table(spark, sf_dir, "events").select(F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT o_orderkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_returnflag = 'R'")
def ext_tests_edges(spark, sf_dir):
    """Tests and what they reach."""
    tests = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    return tests.join(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_partkey").distinct()


@query("SELECT c_custkey, 'name=' || c_name || ';api_token=[REDACTED]' AS shown FROM customer")
def project_redact_frontmatter(spark, sf_dir):
    """Values of secret keys are replaced."""
    front = F.create_map(F.lit("name"), "c_name", F.lit("api_token"), "c_mktsegment")
    safe = F.transform_values(front, lambda k, v: F.when(k.rlike("(?i)token|secret|password|key"), F.lit("[REDACTED]")).otherwise(v))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.transform(F.map_entries(safe), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("shown"))
