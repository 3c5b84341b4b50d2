"""Search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import search as S
from marlstone.operators import trigrams as T
from marlstone.plans.base import query, table
from marlstone.sources.views import FILES_SQL, files


def occurrences_sql(needle: str) -> str:
    n = needle.replace("'", "''")
    return f"""
WITH {FILES_SQL}, cut AS (SELECT doc_id, file_path, string_split(text, '{n}') AS parts FROM files WHERE contains(text, '{n}')),
pieces AS (SELECT doc_id, file_path, parts, unnest(parts) AS piece, generate_subscripts(parts, 1) AS pos FROM cut),
summed AS (SELECT doc_id, file_path, pos, len(parts) AS n,
  sum(length(piece)) OVER w AS chars, sum(strlen(piece)) OVER w AS bytes, sum(length(piece) - length(replace(piece, chr(10), ''))) OVER w AS breaks
  FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT doc_id, file_path, (pos - 1)::BIGINT AS ordinal, (chars + (pos - 1) * {len(needle)})::BIGINT AS char_offset,
  (bytes + (pos - 1) * {len(needle.encode())})::BIGINT AS byte_offset, (breaks + 1)::BIGINT AS line FROM summed WHERE pos < n"""


@query(f"""
WITH {FILES_SQL}, cut AS (SELECT b.item_id, f.doc_id, f.file_path, b.text AS needle, string_split(f.text, b.text) AS parts FROM files f JOIN benchmark b ON length(b.text) > 0 AND contains(f.text, b.text)),
pieces AS (SELECT item_id, doc_id, file_path, needle, parts, unnest(parts) AS piece, generate_subscripts(parts, 1) AS pos FROM cut),
summed AS (SELECT *, sum(length(piece)) OVER w + (pos - 1) * length(needle) AS chars, sum(strlen(piece)) OVER w + (pos - 1) * strlen(needle) AS bytes,
  sum(length(piece) - length(replace(piece, chr(10), ''))) OVER w + (pos - 1) * (length(needle) - length(replace(needle, chr(10), ''))) AS breaks
  FROM pieces WINDOW w AS (PARTITION BY item_id, doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT item_id, doc_id, file_path, (pos - 1)::BIGINT AS ordinal, chars::BIGINT AS char_offset, bytes::BIGINT AS byte_offset, (breaks + 1)::BIGINT AS line FROM summed WHERE pos < len(parts)""")
def search_exact(spark, sf_dir):
    """Every occurrence of every benchmark passage in every document."""
    return S.needles_found(files(spark, sf_dir), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle")))


@query(occurrences_sql("the"))
def search_substring(spark, sf_dir):
    return S.occurrences(files(spark, sf_dir), "the")


@query(occurrences_sql("of the"))
def search_phrase(spark, sf_dir):
    return S.occurrences(files(spark, sf_dir), "of the")


@query(f"""
WITH {FILES_SQL} SELECT doc_id, len(regexp_extract_all(text, '(?i)licen[cs]e[ds]?'))::BIGINT AS matches FROM files WHERE regexp_matches(text, '(?i)licen[cs]e[ds]?')""")
def search_regex(spark, sf_dir):
    return files(spark, sf_dir).where(F.col("text").rlike("(?i)licen[cs]e[ds]?")).select("doc_id", F.regexp_count("text", F.lit("(?i)licen[cs]e[ds]?")).cast("long").alias("matches"))


@query(f"""
WITH {FILES_SQL} SELECT doc_id, file_path, (CASE WHEN lower(file_path) = 'en/src1' THEN 0 WHEN ends_with(lower(file_path), '/en/src1') THEN 1 WHEN starts_with(lower(file_path), 'en/src1') THEN 2 ELSE 3 END)::BIGINT AS rank
FROM files WHERE contains(lower(file_path), 'en/src1')""")
def search_path(spark, sf_dir):
    return S.path_hits(files(spark, sf_dir), "en/src1")


TERMS_SQL = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"


@query(f"""
WITH {FILES_SQL}, ts AS (SELECT doc_id, {TERMS_SQL} AS ts FROM files),
c AS (SELECT doc_id, len(ts) AS len, len(list_filter(ts, lambda t: t = 'license')) AS a, len(list_filter(ts, lambda t: t = 'under')) AS b FROM ts),
s AS (SELECT count(*) AS n, avg(len) AS mean, sum((a > 0)::INT) AS da, sum((b > 0)::INT) AS db FROM c)
SELECT doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (1 - 0.75 + 0.75 * len / mean)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (1 - 0.75 + 0.75 * len / mean)), 6) AS score
FROM c, s WHERE a > 0 AND b > 0""")
def search_symbol_text(spark, sf_dir):
    """BM25 over files that hold every term."""
    return S.bm25(files(spark, sf_dir), ["license", "under"])


@query(f"WITH {FILES_SQL} SELECT doc_id, len({TERMS_SQL})::BIGINT AS n_terms, len(list_distinct({TERMS_SQL}))::BIGINT AS n_distinct FROM files")
def search_tokenise(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", S.terms(F.col("text")).alias("ts")).select("doc_id", F.size("ts").cast("long").alias("n_terms"), F.size(F.array_distinct("ts")).cast("long").alias("n_distinct"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(p_name || '_' || p_brand || 'Of' || p_type, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_./:-]+', ' ', 'g') AS expanded FROM part""")
def search_identifier_expand(spark, sf_dir):
    """camelCase and separators opened up."""
    name = F.concat("p_name", F.lit("_"), "p_brand", F.lit("Of"), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[_./:-]+", " ").alias("expanded"))


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 100 = 0), s AS (
  SELECT query_id, vec_id, round(list_cosine_similarity(query::DOUBLE[], embedding::DOUBLE[]), 6) AS cosine FROM embeddings, q WHERE vec_id <> query_id)
SELECT query_id, vec_id, cosine, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def search_vector_knn(spark, sf_dir):
    """Queries are the vectors whose id is divisible by 100, against all vectors."""
    v = table(spark, sf_dir, "embeddings")
    return S.nearest(v.select("vec_id", "embedding"), v.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 10)


@query("""
WITH q AS (SELECT list(round(x, 9) ORDER BY i) AS query FROM (SELECT i, avg(e) AS x FROM (SELECT unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i))
SELECT vec_id, round(0.55 * least(greatest((list_cosine_similarity(embedding::DOUBLE[], query) + 1) / 2, 0), 1), 5) AS score FROM embeddings, q""")
def search_semantic(spark, sf_dir):
    """Score of every vector against the corpus centre: 0.55 of the cosine moved to 0..1."""
    v = table(spark, sf_dir, "embeddings")
    centre = v.select(F.posexplode("embedding").alias("i", "e")).groupBy("i").agg(F.round(F.avg(F.col("e").cast("double")), 9).alias("x")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("query"))
    return v.join(F.broadcast(centre)).select("vec_id", F.round(0.55 * F.least(F.greatest((S.cosine(F.col("embedding"), F.col("query")) + 1) / 2, F.lit(0.0)), F.lit(1.0)), 5).alias("score"))


HITS_SQL = """hits AS (
  SELECT doc_id, 1.0::DOUBLE AS score, 'source' AS reason FROM documents WHERE contains(text, 'license') UNION ALL
  SELECT doc_id, 1.1, 'exact' FROM documents WHERE contains(text, 'License') UNION ALL
  SELECT doc_id, 0.85, 'title' FROM documents WHERE contains(lower(text), 'licensed under'))"""


def lane_hits(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lane = lambda cond, score, why: d.where(cond).select("doc_id", F.lit(score).alias("score"), F.lit(why).alias("reason"))
    return lane(F.contains("text", F.lit("license")), 1.0, "source").unionAll(lane(F.contains("text", F.lit("License")), 1.1, "exact")).unionAll(lane(F.contains(F.lower("text"), F.lit("licensed under")), 0.85, "title"))


@query(f"WITH {HITS_SQL} SELECT doc_id, max(score) AS score, array_to_string(list_sort(list(DISTINCT reason)), '|') AS reasons, count(*)::BIGINT AS hits FROM hits GROUP BY doc_id")
def search_dedupe(spark, sf_dir):
    return S.dedupe_hits(lane_hits(spark, sf_dir), ["doc_id"])


@query(f"""
WITH {HITS_SQL}, d AS (SELECT doc_id, max(score) AS score FROM hits GROUP BY doc_id), v AS (
  SELECT doc_id, sum(CASE WHEN quality = 1 THEN 0.02 ELSE -0.05 END)::DOUBLE AS boost FROM labels GROUP BY doc_id)
SELECT d.doc_id, round(score + coalesce(boost, 0), 6)::DOUBLE AS score FROM d LEFT JOIN v ON d.doc_id = v.doc_id""")
def search_feedback_boost(spark, sf_dir):
    votes = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "useful").otherwise("dead_end").alias("verdict"))
    return S.boosted(S.dedupe_hits(lane_hits(spark, sf_dir), ["doc_id"]), votes)


@query(f"""
WITH {HITS_SQL}, d AS (SELECT h.doc_id, max(score) AS score, max(source) AS source FROM hits h JOIN documents x ON h.doc_id = x.doc_id GROUP BY h.doc_id)
SELECT doc_id, score, (row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id))::BIGINT AS rank FROM d""")
def search_rank(spark, sf_dir):
    """Rank within the repository: score, then id."""
    from pyspark.sql import Window

    d = S.dedupe_hits(lane_hits(spark, sf_dir), ["doc_id"]).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return d.select("doc_id", "score", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "doc_id")).cast("long").alias("rank"))


@query("""
WITH b AS (SELECT doc_id, source, strlen(text) AS snippet_bytes FROM documents), r AS (
  SELECT *, sum(snippet_bytes) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT doc_id, (CASE WHEN run <= 32000 THEN snippet_bytes WHEN run - snippet_bytes < 32000 THEN 32000 - (run - snippet_bytes) END)::BIGINT AS given_bytes FROM r""")
def win_budget_bytes(spark, sf_dir):
    b = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("snippet_bytes"))
    return S.within_budget(b, 32_000, ["source"], ["doc_id"]).select("doc_id", "given_bytes")


@query("""
WITH t AS (SELECT DISTINCT p_name AS title FROM part), s AS (SELECT title, levenshtein(lower(title), 'part 12') AS distance FROM t)
SELECT title, distance::BIGINT AS distance FROM s WHERE contains(lower(title), 'part 12') OR distance <= 2 ORDER BY distance, title LIMIT 5""")
def search_spelling(spark, sf_dir):
    return S.spelling(table(spark, sf_dir, "part").select(F.col("p_name").alias("title")).distinct(), "part 12")


@query(f"""
WITH {FILES_SQL} SELECT count(*)::BIGINT AS discovered, sum((length(text) >= 20)::INT)::BIGINT AS admitted, sum((length(text) < 20)::INT)::BIGINT AS excluded,
  CASE WHEN sum(contains(text, 'no such needle')::INT) > 0 THEN 'MATCH' WHEN sum((length(text) < 20)::INT) = 0 THEN 'NO_MATCH_VERIFIED' ELSE 'NO_MATCH_INCOMPLETE' END AS status FROM files""")
def search_diagnostics(spark, sf_dir):
    """An empty answer is verified only if nothing was left out."""
    short = F.sum((F.length("text") < 20).cast("long"))
    hits = F.sum(F.contains("text", F.lit("no such needle")).cast("long"))
    return files(spark, sf_dir).agg(F.count("*").alias("discovered"), F.sum((F.length("text") >= 20).cast("long")).alias("admitted"), short.alias("excluded"), F.when(hits > 0, "MATCH").when(short == 0, "NO_MATCH_VERIFIED").otherwise("NO_MATCH_INCOMPLETE").alias("status"))


@query(r"""
SELECT p_partkey, (CASE WHEN lower(p_name) = 'part 1' THEN 100 WHEN starts_with(lower(p_name), 'part 1') THEN 90 WHEN contains(lower(p_name), 'part 1') THEN 70 WHEN contains(lower(p_brand), '1') THEN 40 WHEN contains(lower(p_type), 'a') THEN 20 END)::BIGINT AS score
FROM part WHERE contains(lower(p_name), 'part 1') OR contains(lower(p_brand), '1') OR contains(lower(p_type), 'a')""")
def method_search(spark, sf_dir):
    name, brand, kind = (F.lower(c) for c in ("p_name", "p_brand", "p_type"))
    score = F.when(name == "part 1", 100).when(F.startswith(name, F.lit("part 1")), 90).when(F.contains(name, F.lit("part 1")), 70).when(F.contains(brand, F.lit("1")), 40).when(F.contains(kind, F.lit("a")), 20)
    return table(spark, sf_dir, "part").select("p_partkey", score.cast("long").alias("score")).where("score is not null")


@query("SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), 'p.*t.*7') AND 3.0 / length(p_name) >= 0.3")
def registry_filter(spark, sf_dir):
    """Letters in order, covering enough of the name."""
    return table(spark, sf_dir, "part").where(F.lower("p_name").rlike("p.*t.*7") & (3.0 / F.length("p_name") >= 0.3)).select("p_partkey")


@query(f"""
WITH {FILES_SQL}, x AS (SELECT doc_id, list_filter(list_distinct(list_transform(range(1, greatest(length(text) - 1, 1)::BIGINT), lambda i: substr(text, i, 3))), lambda g: length(g) = 3) AS grams FROM files)
SELECT doc_id, len(grams)::BIGINT AS n_trigrams, list_sort(grams) AS trigrams FROM x""")
def ext_trigrams(spark, sf_dir):
    """Distinct code-point trigrams of each text, and their number."""
    return T.n_grams(files(spark, sf_dir))
