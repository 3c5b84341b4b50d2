"""Graph operators over typed edges (src, dst, edge_type, method, confidence) and nodes (node_id, node_type, title, repo_id).

Traversals are one join per step: the frontier meets the edges, nodes seen before are taken out, and each step's
frontier is written to the shared folder, so that plans stay short and a lost executor costs one step.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import Rounds, cut

#: Methods that a confirmed edge may have.
CONFIRMED = ("EXTRACTED", "ASSERTED")
# Names too general to be hubs.
GENERIC = ("get", "set", "run", "main", "init", "index", "handle", "constructor", "render", "default")


def confirmed(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("method").isin(*CONFIRMED))


def neighbours(edges: DataFrame, node: str, inbound: bool, types: Sequence[str] | None = None) -> DataFrame:
    """(node_id): distinct one-hop neighbours over confirmed edges."""
    here, there = ("dst", "src") if inbound else ("src", "dst")
    out = confirmed(edges).where(F.col(here) == node)
    if types:
        out = out.where(F.col("edge_type").isin(*types))
    return out.select(F.col(there).alias("node_id")).distinct()


def reach(edges: DataFrame, starts: DataFrame, depth: int, inbound: bool = False) -> DataFrame:
    """(node_id, depth): nodes reached from starts (node_id) within `depth` steps, at their least depth; starts are 0."""
    here, there = ("dst", "src") if inbound else ("src", "dst")
    # derived once, however many steps there are; repeated edges stay, only the few nodes that a step reaches are made distinct
    tables = Rounds(edges.sparkSession, "reach")
    step = tables.keep(edges.select(F.col(here).alias("at"), F.col(there).alias("to")))
    seen = tables.keep(starts.select("node_id").distinct().withColumn("depth", F.lit(0).cast("long")))
    frontier = seen
    for d in range(1, depth + 1):
        new = frontier.join(step, frontier["node_id"] == step["at"]).select(F.col("to").alias("node_id")).distinct()
        frontier = tables.keep(new.join(seen.select("node_id"), "node_id", "left_anti").withColumn("depth", F.lit(d).cast("long")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def reach_upwards(members: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(node, depth): as `reach`, over the edges from each member (node, group columns) of a group to those of a greater node. The
    edges, which grow with the square of a group, are never built: who is above any of a step's nodes is above the least of them."""
    tables, groups = Rounds(members.sparkSession, "upwards"), [c for c in members.columns if c != "node"]
    members = tables.keep(members.dropna().distinct())
    seen = frontier = tables.keep(starts.select("node").distinct().withColumn("depth", F.lit(0).cast("long")))
    for d in range(1, depth + 1):
        least = members.join(frontier.select("node"), "node", "left_semi").groupBy(*groups).agg(F.min("node").alias("least"))
        new = members.join(least, groups).where("node > least").select("node").distinct()
        frontier = tables.keep(new.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d).cast("long")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(edges: DataFrame, start: str, goal: str) -> DataFrame:
    """(step, node_id) of the shortest directed path, however long; of equal paths the one whose parents are smallest, from
    the goal back. No path gives no row; a node is its own path. Null ends of edges lead nowhere."""
    spark = edges.sparkSession
    tables = Rounds(spark, "path")
    step = tables.keep(edges.select("src", "dst").where("dst is not null"))
    seen = tables.keep(spark.createDataFrame([(start, None, 0)], "node_id string, parent string, depth long"))
    frontier, found = seen, start == goal
    for d in count(1):
        if found:
            break
        new = frontier.join(step, frontier["node_id"] == step["src"]).groupBy(F.col("dst").alias("node_id")).agg(F.min("src").alias("parent"))
        frontier = tables.keep(new.join(seen.select("node_id"), "node_id", "left_anti").withColumn("depth", F.lit(d).cast("long")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        found = not frontier.where(F.col("node_id") == goal).isEmpty()
    path, at = [], goal if found else None
    while at is not None:  # one lookup for each node of the path
        row = seen.where(F.col("node_id") == at).first()
        path.append((row["depth"], at))
        at = row["parent"]
    return spark.createDataFrame(path, "step long, node_id string")


def degrees(edges: DataFrame, types: Sequence[str]) -> DataFrame:
    """(node_id, degree): ends of edges of these types."""
    some = edges.where(F.col("edge_type").isin(*types))
    return some.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, nodes: DataFrame, types: Sequence[str], first: int, most: int) -> DataFrame:
    """The `first` nodes of highest degree, of these the ones with a telling name, of these the first `most`."""
    top = degrees(edges, types).orderBy(F.desc("degree"), "node_id").limit(first)
    named = top.join(nodes.select("node_id", "title"), "node_id").where(~F.lower("title").isin(*GENERIC))
    return named.orderBy(F.desc("degree"), "node_id").limit(most)


def service_map(edges: DataFrame, nodes: DataFrame, calls: str, serves: str) -> DataFrame:
    """(consumer, provider, endpoints): repositories linked through an endpoint that one side calls and the other serves."""
    repo = nodes.where("repo_id is not null").select("node_id", "repo_id")
    use = edges.where(F.col("edge_type") == calls).join(repo, F.col("src") == F.col("node_id")).select(F.col("dst").alias("endpoint"), F.col("repo_id").alias("consumer")).distinct()
    give = edges.where(F.col("edge_type") == serves).join(repo, F.col("src") == F.col("node_id")).select(F.col("dst").alias("endpoint"), F.col("repo_id").alias("provider")).distinct()
    return use.join(give, "endpoint").where(F.col("consumer") != F.col("provider")).groupBy("consumer", "provider").agg(F.count("*").alias("endpoints"))


def dead_code(nodes: DataFrame, edges: DataFrame, kind: str, types: Sequence[str]) -> DataFrame:
    """Nodes of a kind that no edge of these types comes into."""
    into = edges.where(F.col("edge_type").isin(*types)).select(F.col("dst").alias("node_id"))
    return nodes.where(F.col("node_type") == kind).join(into, "node_id", "left_anti").select("node_id")


def communities(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(node_id, label): synchronous label propagation; a node takes its neighbours' most frequent label, the smallest of
    equals, `rounds` times."""
    both = cut(edges.select("src", "dst").unionAll(edges.select("dst", "src")).where("src <> dst").distinct())
    labels = both.select(F.col("src").alias("node_id")).distinct().withColumn("label", F.col("node_id"))
    order = Window.partitionBy("src").orderBy(F.desc("n"), "label")
    for _ in range(rounds):
        votes = both.join(labels, both["dst"] == labels["node_id"]).groupBy("src", "label").agg(F.count("*").alias("n"))
        labels = cut(votes.withColumn("r", F.row_number().over(order)).where("r = 1").select(F.col("src").alias("node_id"), "label"))
    return labels


def induced(edges: DataFrame, chosen: DataFrame, most: int | None, priority: Sequence[str], back: int = 5) -> DataFrame:
    """(src, dst, edge_type): edges with both ends among the chosen nodes. Of more than `most`, the first so many by type priority and
    ends; chosen nodes that have edges but none of these get their first `back` again, and edges so restored come once."""
    rank = F.coalesce(F.array_position(F.lit(list(priority)), F.col("edge_type")), F.lit(0))
    inside = edges.join(chosen.select(F.col("node_id").alias("src")), "src", "left_semi").join(chosen.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("src", "dst", "edge_type")
    if most is None:
        return inside
    tables, order = Rounds(edges.sparkSession, "induced"), ["priority", "src", "dst", "edge_type"]
    inside = tables.keep(inside.withColumn("priority", F.when(rank > 0, rank).otherwise(99).cast("long")))
    first = tables.keep(inside.orderBy(*order).limit(most))
    # the nodes met are two an edge of `most` at most; sent to the edges, they take out whatever a large node has before it moves
    met = F.broadcast(first.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct())
    alone = inside.select("*", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node_id")).join(met, "node_id", "left_anti")
    restored = alone.withColumn("r", F.row_number().over(Window.partitionBy("node_id").orderBy(*order))).where(F.col("r") <= back)
    return first.select("src", "dst", "edge_type").unionAll(restored.select("src", "dst", "edge_type").distinct())
