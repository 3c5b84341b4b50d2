"""Queries of package manifests: every customer is a repository whose packages are its orders; the SQL knows them without files."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import packages as P
from marlstone.plans.base import query, table
from marlstone.session import new_folder, stored

#: Order k is the package ok at version 1.(k % 4).0. Every third is asked for; each asks for the next of its customer, every fourth for the one after too.
TEXTS = {
    "manifest": """concat('{"name": "c', repo, '", "dependencies": {', array_join(transform(filter(os, k -> k % 6 = 0), k -> concat('"o', k, '": "^1"')), ', '), '}, "devDependencies": {', array_join(transform(filter(os, k -> k % 6 = 3), k -> concat('"o', k, '": "^1"')), ', '), '}}')""",
    "importers": """concat('lockfileVersion: 9\nimporters:\n  .:\n    dependencies:\n', array_join(transform(filter(os, k -> k % 6 = 0 AND k % 7 > 0), k -> concat('      o', k, ':\n        specifier: ^1\n        version: 1.', k % 4, '.0(peer@1)\n')), ''), '    devDependencies:\n', array_join(transform(filter(os, k -> k % 6 = 3 AND k % 7 > 0), k -> concat('      o', k, ':\n        specifier: ^1\n        version: 1.', k % 4, '.0\n')), ''))""",
    "snapshots": """concat('snapshots:\n', array_join(filter(transform(os, (k, i) -> CASE WHEN k % 11 > 0 THEN concat('  o', k, '@1.', k % 4, '.0:\n    dependencies:\n      o', os[(i + 1) % size(os)], ': 1.', os[(i + 1) % size(os)] % 4, '.0\n', CASE WHEN k % 4 = 0 THEN concat('    optionalDependencies:\n      o', os[(i + 2) % size(os)], ': 1.', os[(i + 2) % size(os)] % 4, '.0\n') ELSE '' END) END), x -> x IS NOT NULL), ''))""",
}
GRAPH = """
o AS (SELECT o_custkey AS repo, o_orderkey AS k, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
steps AS (SELECT a.repo, a.k, b.k AS child, max(CASE WHEN (a.i + 1) % a.n = b.i AND NOT (a.k % 4 = 0 AND (a.i + 2) % a.n = b.i) THEN 'dependencies' ELSE 'optionalDependencies' END) AS scope FROM o a JOIN o b ON a.repo = b.repo AND ((a.i + 1) % a.n = b.i OR (a.k % 4 = 0 AND (a.i + 2) % a.n = b.i)) WHERE a.k % 11 > 0 GROUP BY ALL),
direct AS (SELECT repo, k, CASE WHEN k % 6 = 0 THEN 'dependencies' ELSE 'devDependencies' END AS scope, k % 7 > 0 AND repo % 10 < 9 AS resolved FROM o WHERE k % 3 = 0),
r AS (SELECT repo, k, 1 AS depth FROM direct WHERE resolved UNION SELECT r.repo, child, depth + 1 FROM r JOIN steps ON steps.repo = r.repo AND steps.k = r.k WHERE depth < 64),
reached AS (SELECT repo, k, min(depth) AS depth FROM r GROUP BY repo, k),
edges AS (SELECT repo, 'c' || repo AS from_name, 'o' || k AS to_name, CASE WHEN resolved THEN '1.' || k % 4 || '.0' END AS version, scope, 0 AS depth FROM direct
  UNION ALL SELECT reached.repo, 'o' || reached.k, 'o' || child, '1.' || child % 4 || '.0', scope, depth FROM reached JOIN steps ON steps.repo = reached.repo AND steps.k = reached.k)"""


def _closure(spark, sf_dir):
    """Manifests and lock files; a group is a customer's orders."""
    os = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("repo")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("os"))
    os = stored(os, new_folder(spark, "orders"))
    repo = "CAST(repo AS STRING) AS repo_id"
    manifests = os.selectExpr(repo, f"{TEXTS['manifest']} AS text", "concat('root', repo) AS root")
    return P.closure(manifests, os.where("repo % 10 < 9").selectExpr(repo, f"concat({TEXTS['importers']}, {TEXTS['snapshots']}) AS text"))


@query(f"WITH RECURSIVE {GRAPH} SELECT repo::VARCHAR AS repo_id, from_name, to_name, version, scope, depth FROM edges")
def scan_package_manifest(spark, sf_dir):
    """All that each repository depends on, with the round in which it was found."""
    return _closure(spark, sf_dir).edges.select("repo_id", "from_name", "to_name", "version", "scope", "depth")


@query(f"""
WITH RECURSIVE {GRAPH}
SELECT DISTINCT repo::VARCHAR AS repo_id, gap FROM (
  SELECT repo, 'pnpm-lock.yaml not found' AS gap FROM o WHERE repo % 10 = 9
  UNION ALL SELECT repo, 'No lockfile resolution for ' || to_name FROM edges WHERE version IS NULL AND repo % 10 < 9
  UNION ALL SELECT repo, 'No lockfile snapshot for o' || k || '@1.' || k % 4 || '.0' FROM reached WHERE k % 11 = 0)""")
def scan_package_gaps(spark, sf_dir):
    return _closure(spark, sf_dir).gaps
