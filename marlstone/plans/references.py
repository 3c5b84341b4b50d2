"""The query of the reference ladder: parts are symbols, line items refer to them; the SQL looks at every candidate."""

from __future__ import annotations

from marlstone.operators import references as R
from marlstone.plans.base import query
from marlstone.plans.knowledge import View

SYMBOLS = View("part", "concat('k', p_partkey) AS symbol_id", "'r' AS repo_id", "concat('f', p_partkey % 50) AS file_path", "concat(CASE WHEN p_partkey % 3 = 0 THEN 'N.s' ELSE 'D.s' END, floor(p_partkey / 3)::INT) AS qualified_name", "concat('s', floor(p_partkey / 3)::INT) AS name")
REFS = View(
    "lineitem", "concat(l_orderkey, '.', l_linenumber, '.', l_partkey, '.', l_suppkey) AS ref_id", "'r' AS repo_id", "concat('f', l_suppkey % 60) AS file_path", "CASE l_linenumber % 5 WHEN 0 THEN 'type' WHEN 1 THEN 'jsx-component' WHEN 2 THEN 'jsx-callback' ELSE 'call' END AS kind",
    "concat(CASE WHEN l_partkey % 7 = 0 THEN 'N.' ELSE '' END, 's', floor(l_partkey / 3)::INT) AS raw_name", "CASE l_returnflag WHEN 'A' THEN 'this.x' WHEN 'R' THEN 'Date' END AS receiver", "CASE WHEN l_quantity < 48 THEN concat('k', l_suppkey) END AS src",
)
IMPORTS = View("supplier", "'r' AS repo_id", "concat('f', s_suppkey % 60) AS file_path", "concat('f', s_suppkey * 7 % 50) AS imported")


@query(f"""
WITH r AS (SELECT DISTINCT *, 's' || split_part(raw_name, 's', 2) AS name FROM {REFS.sql}), y AS {SYMBOLS.sql}, i AS (SELECT DISTINCT * FROM {IMPORTS.sql}),
c AS (SELECT r.*, y.symbol_id, y.file_path = r.file_path AS own, y.file_path = r.file_path OR EXISTS (SELECT 1 FROM i WHERE i.file_path = r.file_path AND i.imported = y.file_path) AS near FROM r LEFT JOIN y ON y.name = r.name),
a AS (SELECT ref_id, any_value(kind) AS kind, any_value(raw_name) AS raw_name, any_value(receiver) AS receiver, any_value(src) AS src, count(symbol_id) FILTER (WHERE own) AS own_n, min(symbol_id) FILTER (WHERE own) AS own_one,
  count(symbol_id) FILTER (WHERE near AND symbol_id <> src) AS near_n, min(symbol_id) FILTER (WHERE near AND symbol_id <> src) AS near_one, count(symbol_id) FILTER (WHERE symbol_id <> src) AS all_n, min(symbol_id) FILTER (WHERE symbol_id <> src) AS all_one FROM c GROUP BY ref_id),
q AS (SELECT a.*, (SELECT min(symbol_id) FROM y WHERE qualified_name = raw_name HAVING count(*) = 1) AS q_one, starts_with(kind, 'jsx') AS jsx, kind = 'type' OR kind = 'call' AND receiver IS NOT NULL AS owned, contains(raw_name, '.') AS out FROM a),
l AS (SELECT *, CASE WHEN src IS NULL THEN 'no_source' WHEN own_n = 1 AND own_one <> src THEN 'same_file' WHEN kind = 'call' AND receiver = 'Date' THEN 'platform' WHEN q_one <> src AND (jsx OR out OR NOT owned) THEN 'qualified' WHEN q_one = src AND NOT jsx AND (out OR NOT owned) THEN 'itself'
  WHEN near_n = 1 THEN 'imported' WHEN jsx THEN 'ambiguous' WHEN near_n > 1 THEN 'ambiguous' WHEN owned THEN 'unscoped' WHEN all_n = 1 THEN 'unique' WHEN all_n BETWEEN 2 AND 6 THEN 'guess' WHEN all_n = 0 THEN 'unknown' ELSE 'ambiguous' END AS rung FROM q)
SELECT ref_id, rung, CASE rung WHEN 'same_file' THEN own_one WHEN 'qualified' THEN q_one WHEN 'imported' THEN near_one WHEN 'unique' THEN all_one WHEN 'guess' THEN all_one END AS dst, CASE WHEN dst IS NULL THEN NULL WHEN jsx THEN 0.5 WHEN rung = 'guess' THEN round(1 / all_n, 6) END::DOUBLE AS confidence FROM l""")
def ext_resolve_ladder(spark, sf_dir):
    found = R.resolved(REFS.df(spark, sf_dir).distinct(), SYMBOLS.df(spark, sf_dir), IMPORTS.df(spark, sf_dir))
    return found.selectExpr("ref_id", "rung", "dst", "round(confidence, 6) AS confidence")
