"""More search queries: caps, prefilters, structural names, scopes, suggestions, snippets, pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions.text import wildcard
from marlstone.operators import search as S
from marlstone.operators import trigrams as T
from marlstone.plans.base import query, table
from marlstone.plans.search import TERMS_SQL, occurrences_sql
from marlstone.sources.views import FILES_SQL, NODES_SQL, files, nodes
from marlstone.session import new_folder


@query(f"SELECT doc_id, ordinal FROM ({occurrences_sql('the')}) ORDER BY doc_id, ordinal LIMIT 5001")
def search_cap(spark, sf_dir):
    """5000 occurrences and one more, which says that there are others."""
    return S.occurrences(files(spark, sf_dir), "the").select("doc_id", "ordinal").orderBy("doc_id", "ordinal").limit(5001)


NEEDLES = ["license", "the Art", "of", "zq!zq"]


def has_grams(needle: str) -> str:
    return " AND ".join(f"contains(lower(text), '{g}')" for g in sorted({needle.lower()[i : i + 3] for i in range(len(needle) - 2)})) or "true"


@query(" UNION ALL ".join(f"SELECT {i}::BIGINT AS item_id, doc_id, contains(text, '{n}') AS verified FROM documents WHERE {has_grams(n)}" for i, n in enumerate(NEEDLES) if len(n) > 2))
def search_trigram_prefilter(spark, sf_dir):
    """Files in the postings of every trigram of each needle, and whether they hold the needle."""
    docs = files(spark, sf_dir)
    index = T.build(docs, new_folder(spark, "trigrams"))
    found = T.candidates(index, T.plan(index, _needles(spark), rarest=None))
    return found.join(docs.select("doc_id", "text"), "doc_id").select("item_id", "doc_id", F.contains("text", F.col("needle")).alias("verified"))


def words_sql(i: int, needle: str) -> str:
    """Whole words without case, as pieces between occurrences."""
    edge = "regexp_matches({}, '[\\p{{L}}\\p{{N}}_]')".format
    low = needle.lower()
    before, after = f"CASE WHEN parts[k] <> '' THEN right(parts[k], 1) WHEN k > 1 THEN '{low[-1]}' ELSE '' END", f"CASE WHEN parts[k + 1] <> '' THEN left(parts[k + 1], 1) WHEN k + 1 < len(parts) THEN '{low[0]}' ELSE '' END"
    return f"SELECT {i}::BIGINT AS item_id, doc_id, count(*) AS hits, min(chars)::BIGINT AS first FROM (SELECT doc_id, k, {before} AS b, {after} AS a, length(array_to_string(parts[1:k], '{low}')) AS chars FROM (SELECT doc_id, parts, unnest(range(1, len(parts)::BIGINT)) AS k FROM (SELECT doc_id, string_split(lower(text), '{low}') AS parts FROM documents WHERE contains(lower(text), '{low}')))) WHERE NOT {edge('a')} AND NOT {edge('b')} GROUP BY doc_id"


@query(" UNION ALL ".join(words_sql(i, n) for i, n in enumerate(NEEDLES)))
def search_whole_word(spark, sf_dir):
    """Whole-word hits without case by way of the index; a short needle goes to all files."""
    docs = files(spark, sf_dir)
    index = T.build(docs, new_folder(spark, "trigrams"))
    hits = T.search(docs, index, _needles(spark), case_sensitive=False, whole_word=True)
    return hits.groupBy("item_id", "doc_id").agg(F.count("*").alias("hits"), F.min("char_offset").alias("first"))


def _needles(spark):
    return spark.createDataFrame(list(enumerate(NEEDLES)), "item_id long, needle string")


@query(f"SELECT p_partkey, p_name FROM (SELECT p_partkey, p_name, p_name AS text FROM part) WHERE list_has_all({TERMS_SQL}, ['part', '7'])")
def search_identifiers(spark, sf_dir):
    """Names that hold every word asked for."""
    ts = S.terms(F.col("p_name"))
    return table(spark, sf_dir, "part").where(F.array_contains(ts, "part") & F.array_contains(ts, "7")).select("p_partkey", "p_name")


@query(f"WITH {NODES_SQL} SELECT node_id, title FROM nodes WHERE node_type IN ('region', 'nation', 'supplier') AND (contains(lower(title), 'an') OR contains(lower(node_id), 'an'))")
def search_structural_nodes(spark, sf_dir):
    hit = F.contains(F.lower("title"), F.lit("an")) | F.contains(F.lower("node_id"), F.lit("an"))
    return nodes(spark, sf_dir).where(F.col("node_type").isin("region", "nation", "supplier") & hit).select("node_id", "title")


@query(f"WITH {FILES_SQL} SELECT doc_id, (CASE WHEN contains(text, 'released under') THEN 1.1 WHEN contains(lower(text), 'released under') THEN 1.0 WHEN file_path = 'en/src1/7.txt' THEN 1.2 WHEN contains(file_path, 'src1') THEN 0.7 ELSE 0.0 END)::DOUBLE AS score FROM files")
def search_scores(spark, sf_dir):
    """Scores of the lanes: exact text, text, exact path, path."""
    score = F.when(F.contains("text", F.lit("released under")), 1.1).when(F.contains(F.lower("text"), F.lit("released under")), 1.0).when(F.col("file_path") == "en/src1/7.txt", 1.2).when(F.contains("file_path", F.lit("src1")), 0.7)
    return files(spark, sf_dir).select("doc_id", score.otherwise(0.0).alias("score"))


@query("""WITH a AS (SELECT lower(n_name) AS alias, n_name AS canonical FROM nation UNION ALL SELECT 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation)
SELECT alias, min(canonical) AS canonical, 0.04::DOUBLE AS boost FROM a GROUP BY alias HAVING count(DISTINCT canonical) = 1""")
def search_ontology_expand(spark, sf_dir):
    """Aliases that name one concept only; the others expand to nothing."""
    n = table(spark, sf_dir, "nation")
    a = n.select(F.explode(F.array(F.lower("n_name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))).alias("alias"), "n_name")
    return a.groupBy("alias").agg(F.min("n_name").alias("canonical"), F.count_distinct("n_name").alias("n")).where("n = 1").select("alias", "canonical", F.lit(0.04).alias("boost"))


@query(f"WITH {FILES_SQL} SELECT file_path FROM files WHERE length(text) < 120 AND contains(file_path, 'src') ORDER BY file_path LIMIT 5")
def search_exclusions(spark, sf_dir):
    """The first excluded paths that match."""
    return files(spark, sf_dir).where((F.length("text") < 120) & F.contains("file_path", F.lit("src"))).select("file_path").orderBy("file_path").limit(5)


@query("""WITH s AS (SELECT unnest(['SRC1', 'src2', 'nope']) AS selector), r AS (SELECT DISTINCT source AS repo FROM documents), m AS (SELECT selector, repo FROM s LEFT JOIN r ON lower(selector) = lower(repo))
SELECT selector, repo, CASE WHEN (SELECT count(*) FROM m WHERE repo IS NULL) > 0 THEN 'SCOPE_ERROR' ELSE 'OK' END AS status FROM m""")
def search_scope_match(spark, sf_dir):
    """Selectors without regard to case; one that names nothing spoils the scope."""
    wanted = spark.createDataFrame([("SRC1",), ("src2",), ("nope",)], "selector string")
    repos = table(spark, sf_dir, "documents").select(F.col("source").alias("repo")).distinct()
    m = F.broadcast(wanted).join(repos, F.lower("selector") == F.lower("repo"), "left")
    bad = m.agg(F.sum(F.col("repo").isNull().cast("long")).alias("bad"))  # one row
    return m.join(F.broadcast(bad)).select("selector", "repo", F.when(F.col("bad") > 0, "SCOPE_ERROR").otherwise("OK").alias("status"))


@query("SELECT event_type AS name, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND contains(event_type, 'i')")
def saved_query(spark, sf_dir):
    """Saves by name, the newest wins; of these the names that hold a letter."""
    best = F.max_by(F.struct("event_id", "user_id"), F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").where(F.contains("event_type", F.lit("i"))).groupBy(F.col("event_type").alias("name")).agg(best.alias("b")).select("name", "b.event_id", "b.user_id")


@query("SELECT DISTINCT p_brand, (CASE WHEN starts_with(lower(p_brand), 'brand#1') THEN 0 ELSE 1 END)::BIGINT AS rank FROM part WHERE contains(lower(p_brand), '1') ORDER BY rank, p_brand LIMIT 10")
def registry_stem_suggest(spark, sf_dir):
    """Families that begin with the stem, then those that hold it."""
    b = F.lower("p_brand")
    return table(spark, sf_dir, "part").where(F.contains(b, F.lit("1"))).select("p_brand", F.when(F.startswith(b, F.lit("brand#1")), 0).otherwise(1).cast("long").alias("rank")).distinct().orderBy("rank", "p_brand").limit(10)


@query("SELECT p_partkey FROM part WHERE regexp_full_match(lower(p_name), 'p.rt .*7')")
def vault_match(spark, sf_dir):
    """`*` for any text and `?` for one character."""
    return table(spark, sf_dir, "part").where(F.lower("p_name").rlike(wildcard("p?rt *7"))).select("p_partkey")


@query("""WITH l AS (SELECT page_id, string_split(coalesce(html, ''), chr(10)) AS parts FROM pages), e AS (SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS n FROM l)
SELECT page_id, n::BIGINT AS line, (len(string_split(lower(part), 'li')) - 1)::BIGINT AS matches FROM e WHERE contains(lower(part), 'li')""")
def response_find(spark, sf_dir):
    """Matches of each line, without regard to case and without overlaps."""
    lines = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split(F.coalesce("html", F.lit("")), "\n")).alias("n", "part")).where(F.contains(F.lower("part"), F.lit("li")))
    return lines.select("page_id", (F.col("n") + 1).cast("long").alias("line"), (F.size(F.split(F.lower("part"), "li")) - 1).cast("long").alias("matches"))


@query(f"""WITH {FILES_SQL}, h AS (SELECT doc_id, string_split(text, chr(10)) AS lines, len(string_split(substr(text, 1, strpos(text, 'the') - 1), chr(10))) AS hit_line FROM files WHERE contains(text, 'the'))
SELECT doc_id, greatest(hit_line - 1, 1)::BIGINT AS start_line, least(hit_line + 1, len(lines))::BIGINT AS end_line, sha256(array_to_string(lines[greatest(hit_line - 1, 1):least(hit_line + 1, len(lines))], chr(10))) AS snippet_hash FROM h""")
def search_hit_hydrate(spark, sf_dir):
    """The line of the first hit with its neighbours."""
    before = F.expr("substring(text, 1, locate('the', text) - 1)")
    h = files(spark, sf_dir).where(F.contains("text", F.lit("the"))).select("doc_id", F.split("text", "\n").alias("lines"), F.size(F.split(before, "\n")).alias("at"))
    h = h.withColumn("a", F.greatest(F.col("at") - 1, F.lit(1))).withColumn("b", F.least(F.col("at") + 1, F.size("lines")))
    return h.select("doc_id", F.col("a").cast("long").alias("start_line"), F.col("b").cast("long").alias("end_line"), F.sha2(F.array_join(F.slice("lines", F.col("a"), F.col("b") - F.col("a") + 1), "\n"), 256).alias("snippet_hash"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey > 7) ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def win_page_after(spark, sf_dir):
    """The page after the cursor (200000, 7), best first."""
    o = table(spark, sf_dir, "orders").where("o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey > 7)")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 100")
def sort_multi_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS date FROM orders ORDER BY date DESC NULLS LAST, o_orderkey LIMIT 100")
def sort_nulls_last(spark, sf_dir):
    dated = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("date"))
    return dated.orderBy(F.col("date").desc_nulls_last(), "o_orderkey").limit(100)


@query("SELECT o_orderkey FROM orders ORDER BY (o_orderstatus = 'P') DESC, o_orderkey LIMIT 100")
def sort_bool_first(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy((F.col("o_orderstatus") == "P").desc(), "o_orderkey").limit(100).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 50")
def limit_unordered(spark, sf_dir):
    """A limit always gets a total order."""
    return table(spark, sf_dir, "customer").where("c_acctbal < 0").orderBy("c_custkey").limit(50).select("c_custkey")


@query(f"WITH {FILES_SQL} SELECT repo_id, file_path, row_number() OVER (PARTITION BY repo_id, lang ORDER BY file_path)::BIGINT AS place FROM files")
def graph_list_files(spark, sf_dir):
    """Files of each repository and language in path order."""
    place = F.row_number().over(Window.partitionBy("repo_id", "lang").orderBy("file_path"))
    return files(spark, sf_dir).select("repo_id", "file_path", place.cast("long").alias("place"))
