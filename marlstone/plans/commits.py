"""Queries over commits: every customer is a repository and its orders are commits; the SQL works out whole closures."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import commits as C
from marlstone.operators import knowledge as K
from marlstone.plans.base import query, table
from marlstone.session import new_folder, stored

#: Parents of a customer's n-th order: the one before, or the second before for every fifth, and the third before too for every fourth.
LINKS = """
o AS (SELECT o_custkey AS repo, o_orderkey AS sha, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
links AS (SELECT DISTINCT c.repo, c.sha, p.sha AS parent FROM o c JOIN o p ON c.repo = p.repo AND (p.n = c.n - CASE WHEN c.sha % 5 = 0 THEN 2 ELSE 1 END OR c.sha % 4 = 0 AND p.n = c.n - 3)),
pairs AS (SELECT repo, max(sha) AS head, max(CASE WHEN n = m THEN sha END) AS base FROM (SELECT *, max(n) OVER (PARTITION BY repo) - 1 AS m FROM o) GROUP BY repo),
up AS (SELECT repo, 1 AS side, head AS sha FROM pairs UNION SELECT repo, 2, base FROM pairs WHERE base IS NOT NULL UNION SELECT up.repo, side, parent FROM up JOIN links USING (repo, sha)),
painted AS (SELECT repo, sha, sum(side) AS flags FROM up GROUP BY ALL),
best AS (SELECT repo, sha FROM painted WHERE flags = 3 AND NOT EXISTS (SELECT 1 FROM links JOIN painted c ON c.repo = links.repo AND c.sha = links.sha AND c.flags = 3 WHERE links.repo = painted.repo AND links.parent = painted.sha))"""


def _commits(spark, sf_dir):
    """Commits with generations; a window is a customer's orders."""
    o = "SELECT o_custkey AS repo, o_orderkey AS sha, lag(o_orderkey, 1) OVER w AS p1, lag(o_orderkey, 2) OVER w AS p2, lag(o_orderkey, 3) OVER w AS p3 FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"
    rows = spark.sql(o, orders=table(spark, sf_dir, "orders"))
    commits = rows.selectExpr("repo AS repo_id", "CAST(sha AS STRING) AS sha", "transform(array_compact(array(CASE WHEN sha % 5 = 0 THEN p2 ELSE p1 END, CASE WHEN sha % 4 = 0 THEN p3 END)), x -> CAST(x AS STRING)) AS parents")
    folder = new_folder(spark, "commits")
    commits = stored(commits, f"{folder}/read")
    return stored(commits.join(C.generations(commits), ["repo_id", "sha"]), f"{folder}/numbered")


def _pairs(spark, sf_dir):
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("repo_id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("os"))
    pairs = last.select(F.col("repo_id").alias("pair_id"), "repo_id", F.try_element_at("os", F.lit(-1)).cast("string").alias("head"), F.try_element_at("os", F.lit(-2)).cast("string").alias("base"))
    return stored(pairs, new_folder(spark, "pairs"))


@query(f"""
WITH RECURSIVE {LINKS},
depth AS (SELECT repo, sha, 1 AS g FROM o WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.repo = o.repo AND l.sha = o.sha) UNION SELECT l.repo, l.sha, g + 1 FROM depth d JOIN links l ON l.repo = d.repo AND l.parent = d.sha)
SELECT repo AS repo_id, sha::VARCHAR AS sha, max(g)::BIGINT AS generation FROM depth GROUP BY ALL""")
def scan_git_generations(spark, sf_dir):
    return _commits(spark, sf_dir).select("repo_id", "sha", "generation")


@query(f"""
WITH RECURSIVE {LINKS}
SELECT pairs.repo AS pair_id, CASE WHEN base IS NULL THEN 'missing_head' ELSE 'complete' END AS state,
  CASE WHEN base IS NOT NULL THEN (SELECT string_agg(sha::VARCHAR, ',' ORDER BY sha) FROM best b WHERE b.repo = pairs.repo) END AS bases,
  CASE WHEN base IS NOT NULL THEN (SELECT count(*) FROM painted x WHERE x.repo = pairs.repo AND flags = 1) END AS ahead, CASE WHEN base IS NOT NULL THEN (SELECT count(*) FROM painted x WHERE x.repo = pairs.repo AND flags = 2) END AS behind FROM pairs""")
def git_topology(spark, sf_dir):
    """The two latest orders of each customer as heads: what they have in common, and how far they are from it."""
    found = C.merge_bases(_commits(spark, sf_dir), _pairs(spark, sf_dir))
    # listed by number, as the SQL does
    listed = F.array_join(F.transform(F.array_sort(F.transform("merge_bases", lambda x: x.cast("long"))), lambda x: x.cast("string")), ",")
    return found.select("pair_id", "state", F.when(F.size("merge_bases") > 0, listed).alias("bases"), "ahead", "behind")


@query(f"""
WITH RECURSIVE {LINKS},
first AS (SELECT p.repo, p.head, (SELECT max(sha) FROM best b WHERE b.repo = p.repo) AS base FROM pairs p WHERE p.base IS NOT NULL)
SELECT DISTINCT repo AS repo_id, base::VARCHAR AS base_commit FROM first WHERE base IS NOT NULL AND base <> head AND base % 3 > 0""")
def base_materialise(spark, sf_dir):
    """Merge bases of a feature branch that no snapshot has yet: those to be built before their children."""
    pairs = _pairs(spark, sf_dir)
    bases = C.merge_bases(_commits(spark, sf_dir), pairs).join(pairs, "pair_id")
    # the latest of several bases, as the SQL takes it
    latest = F.array_max(F.transform("merge_bases", lambda x: x.cast("long"))).cast("string")
    none = F.lit(None).cast("string")
    asked = bases.where("state = 'complete'").select("repo_id", F.col("head").alias("head_commit"), none.alias("prior_snapshot_id"), none.alias("prior_commit"), F.lit("feature").alias("target_branch"), F.lit("main").alias("canonical_branch"), none.alias("merge_base_snapshot_id"), latest.alias("merge_base_commit"), none.alias("canonical_snapshot_id"), none.alias("canonical_commit"), F.lit("complete").alias("history"))
    snapshots = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").selectExpr("o_custkey AS repo_id", "CAST(o_orderkey AS STRING) AS commit")
    return C.bases_to_build(K.branch_bases(asked), snapshots)
