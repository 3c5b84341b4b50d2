"""Graph queries on rows that the driver's tables don't have, and work that must not grow with the square of a group."""

import random
import time

import duckdb
import pytest

from marlstone.operators import graph as G
from marlstone.plans import registry
from marlstone.session import spread


def both(spark, tmp_path, name, tables):
    """Rows of a query and of its SQL over made tables (name, schema, rows), and the query's seconds."""
    con = duckdb.connect()
    for t, schema, rows in tables:
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    began = time.perf_counter()
    df = registry.QUERIES[name](spark, str(tmp_path))
    got = sorted(map(tuple, df.collect()), key=repr)
    took = time.perf_counter() - began
    found = con.sql(registry.ORACLE_SQL[name])
    at = [found.columns.index(c) for c in df.columns]
    return got, sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr), took


PART = "p_partkey long, p_name string, p_brand string, p_size int"
ODD = [(7, "a", "x", 1), (8, "a", "x", 1), (8, "a", "y", 2), (9, "a", None, 1), (9, "b", "y", 2), (10, None, "y", 2), (None, "a", "x", 1), (3, "a", "x", 1), (8, "a", "x", 1), (12, "b", "y", None), (11, "c", "x", 1), (13, "c", None, 2), (14, "c", None, 2), (5, "b", "y", 2)]


@pytest.mark.parametrize("name", ["graph_compare_branches", "graph_pkg_deps"])
def test_odd_parts(spark, tmp_path, name):
    got, want, _ = both(spark, tmp_path, name, [("part", PART, ODD)])
    assert got == want and len(got) > 3


@pytest.mark.parametrize("name", ["graph_compare_branches", "graph_pkg_deps"])
def test_one_large_group(spark, tmp_path, name):
    n = 60_000
    spark.range(n).selectExpr("id AS p_partkey", "'a' AS p_name", "'x' AS p_brand", "1 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    began = time.perf_counter()
    got = [tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()]
    assert time.perf_counter() - began < 25
    assert got == [("a", True, n * (n - 1) // 2)] if name == "graph_compare_branches" else sorted(got) == sorted([("7", 0)] + [(str(i), 1) for i in range(8, n)])


def test_spread_by_rows(spark):
    df = spark.range(1000).selectExpr("id % 10 AS a", "id AS b")
    assert spread(df, 1000, "a", each=100).rdd.getNumPartitions() == 10
    assert spread(df, 1000, "a", each=1000).rdd.getNumPartitions() == df.rdd.getNumPartitions()
    assert spread(df, 1000, "a", each=100).groupBy("a").count().count() == 10


def test_edges_are_not_made_distinct(spark, monkeypatch):
    """Repeated edges give the same reach and path; no table of theirs is shuffled as a whole."""
    seen = []
    monkeypatch.setattr(G.Rounds, "keep", lambda self, df, keep=G.Rounds.keep: (seen.append(df._jdf.queryExecution().executedPlan().toString()), keep(self, df))[1])
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("b", "c"), ("c", "a"), (None, "b"), ("c", None)], "src string, dst string")
    starts = spark.createDataFrame([("a",), ("a",)], "node_id string")
    assert {tuple(r) for r in G.reach(e, starts, 3).where("node_id is not null").collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert sorted(tuple(r) for r in G.shortest_path(e, "a", "c").collect()) == [(0, "a"), (1, "b"), (2, "c")]
    tables = [p for p in seen if "BroadcastHashJoin" not in p and "SortMergeJoin" not in p]
    assert len([p for p in tables if "hashpartitioning" not in p]) >= 2


def collected(edges, chosen, most, priority, back):
    """What is to come of the edges among chosen nodes, in plain Python: the first, then what each node left out has of its own."""
    order = lambda e: (priority.index(e[2]) if e[2] in priority else 99, *e)
    inside = sorted((e for e in edges if e[0] in chosen and e[1] in chosen), key=order)
    first = inside[:most]
    met = {n for e in first for n in e[:2]}
    return first + list({e for n in chosen - met for e in [e for e in inside if n in e[:2]][:back]})


@pytest.mark.parametrize("most, back", [(0, 5), (1, 1), (6, 2), (30, 5), (1000, 5), (None, 5)])
def test_nodes_that_a_cut_leaves_out_are_restored(spark, most, back):
    rng, priority = random.Random(7), ["calls", "references"]
    edges = [(f"n{rng.randrange(40)}", f"n{rng.choice([0, 1, rng.randrange(40)])}", rng.choice(["calls", "references", "defines", "handles"])) for _ in range(150)]
    edges += edges[:20] + [("n3", "n3", "defines"), ("n39", "n39", "handles"), (None, "n1", "calls"), ("n2", None, "calls")]
    chosen = {f"n{i}" for i in range(40)} - {"n5", "n6"} | {"gone"}
    made = spark.createDataFrame(edges, "src string, dst string, edge_type string").repartition(5)
    got = G.induced(made, spark.createDataFrame([(n,) for n in [*chosen, *chosen, None]], "node_id string"), most, priority, back)
    assert sorted(map(tuple, got.collect())) == sorted(collected(edges, chosen, most, priority, back))


def test_a_node_with_many_neighbours_keeps_all_of_them(spark, tmp_path):
    """Of 1,500 customers of one nation that have no other edge among them, none is left without it."""
    customers = [(i, f"c{i}", 7 if i <= 1500 else 8) for i in range(1, 1601)]
    tables = [
        ("region", "r_regionkey int, r_name string", [(2, "r")]),
        ("nation", "n_nationkey int, n_name string, n_regionkey int", [(7, "n7", 2), (8, "n8", 2)]),
        ("customer", "c_custkey long, c_name string, c_nationkey int", customers),
        ("supplier", "s_suppkey long, s_name string, s_nationkey int", [(1, "s", 7), (2, "s", 8)]),
        ("orders", "o_orderkey long, o_custkey long, o_orderstatus string", [(1, 1, "P"), (2, 2, "O")]),
        ("lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string", [(1, 1, 1, "A"), (2, 1, 2, "N")]),
    ]
    got, want, _ = both(spark, tmp_path, "graph_collect", tables)
    assert got == want == sorted([("nation:7", "region:2", "defines"), ("supplier:1", "nation:7", "defines"), *((f"customer:{i}", "nation:7", "defines") for i in range(1, 1501))], key=repr)


def test_a_large_node_is_cut_before_it_moves(spark):
    """Each task keeps a node's first edges only, and nothing moves of nodes that the cut has met."""
    made = spark.range(1000).selectExpr("'hub' AS src", "concat('n', id) AS dst", "'calls' AS edge_type")
    plan = G.induced(made, made.selectExpr("explode(array(src, dst)) AS node_id").distinct(), 10, ["calls"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("WindowGroupLimit") == 2


def test_repository_view_has_every_edge(spark, tmp_path):
    """No cut that its SQL doesn't have, not even of repeated rows."""
    tables = [
        ("region", "r_regionkey int, r_name string", [(1, "r")]),
        ("nation", "n_nationkey int, n_name string, n_regionkey int", [(1, "n1", 1)]),
        ("customer", "c_custkey long, c_name string, c_nationkey int", [(1, "c", 1)] * 1200),
        ("supplier", "s_suppkey long, s_name string, s_nationkey int", [(1, "s", 1)]),
        ("part", "p_partkey long, p_name string", [(1, "p")]),
        ("orders", "o_orderkey long, o_custkey long, o_orderstatus string", [(1, 1, "P")]),
        ("lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string", [(1, 1, 1, "A")]),
    ]
    got, want, _ = both(spark, tmp_path, "graph_repo_view", tables)
    assert got == want and len(got) == 1200
