"""Packages of repositories: what manifests ask for, what lock files resolve, and all that follows from it.

Manifests are JSON read by from_json. Lock files are YAML of a known shape: its lines are rows, and windows over one file carry
the last key of each depth, so sections, importers and snapshots come out as tables. From the direct dependencies of every
repository at once, a closure goes from package to snapshot to its dependencies, a level a round; each round is a join and an
anti join, and only packages that are new in a repository go on.

Defined cases: a manifest that is null or no JSON has no dependencies and a gap; a repository without lock file has the gap
of that, and keeps its direct dependencies unresolved; an entry without version, or a version without snapshot, is a gap and
not an error. Of snapshots that differ in their peers only, the first in the file stands for the version. A package that is asked
for twice is gone through once. Of several manifests or lock files of one repository the least text is taken.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import Rounds

# The scopes of a manifest.
SCOPES = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")
LOCK = "pnpm-lock.yaml"


class Closure(NamedTuple):
    """dependencies: repo_id, name, specifier, scope, version, source. edges: repo_id, from_name, from_version, to_name, specifier,
    scope, version, source, depth. gaps: repo_id, gap."""

    dependencies: DataFrame
    edges: DataFrame
    gaps: DataFrame


def manifest_entries(manifests: DataFrame) -> DataFrame:
    """(repo_id, package, scope, name, specifier) of manifests (repo_id, text); a row without name where there is none."""
    kind = ", ".join(f"{s} map<string,string>" for s in SCOPES)
    read = manifests.groupBy("repo_id").agg(F.min("text").alias("text")).withColumn("m", F.from_json("text", f"name string, {kind}"))

    def of(scope: str) -> Column:
        found = F.map_entries(F.coalesce(F.col(f"m.{scope}"), F.create_map().cast("map<string,string>")))
        return F.transform(found, lambda e: F.struct(F.lit(scope).alias("scope"), e["key"].alias("name"), e["value"].alias("raw")))

    listed = F.concat(*[of(s) for s in SCOPES])
    rows = read.select("repo_id", F.col("m.name").alias("package"), F.explode_outer(listed).alias("e"))
    return rows.select("repo_id", "package", F.col("e.scope").alias("scope"), F.col("e.name").alias("name"), F.when(F.startswith("e.raw", F.lit("{")), F.get_json_object("e.raw", "$.specifier")).otherwise(F.col("e.raw")).alias("specifier"))


def plain_version(version: Column) -> Column:
    """A version without the peers in brackets; empty ones are null."""
    return F.nullif(F.substring_index(version, "(", 1), F.lit(""))


def lock_lines(locks: DataFrame) -> DataFrame:
    """(repo_id, pos, k0, k2, k4, k6, k8, value): each line that has a key, with the keys above it by indentation."""
    lines = locks.groupBy("repo_id").agg(F.min("text").alias("text")).select("repo_id", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))
    pattern = r"^( *)(?:'([^']+)'|\"([^\"]+)\"|([^\s'\"#:][^:]*(?::[^\s:][^:]*)*))\s*:(?:\s+(.*?))?\s*$"
    part = lambda k: F.regexp_extract("line", pattern, k)
    keyed = lines.where(F.col("line").rlike(pattern)).select("repo_id", "pos", F.length(part(1)).alias("deep"), F.concat(part(2), part(3), part(4)).alias("key"), F.regexp_replace(part(5), r"^(['\"])(.*)\1$", "$2").alias("value"))
    before = Window.partitionBy("repo_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    for d in (0, 2, 4, 6, 8):
        keyed = keyed.withColumn(f"s{d}", F.last(F.when(F.col("deep") == d, F.struct("pos", "key")), ignorenulls=True).over(before))
    out = keyed.select("repo_id", "pos", "deep", F.col("s0.key").alias("k0"), *[F.when((F.col("deep") >= d) & (F.col(f"s{d}.pos") > F.col(f"s{d - 2}.pos")), F.col(f"s{d}.key")).alias(f"k{d}") for d in (2, 4, 6, 8)], "value")
    return out


def closure(manifests: DataFrame, locks: DataFrame) -> Closure:
    """What manifests (repo_id, text, root: the folder's name) and lock files (repo_id, text) say together."""
    tables = Rounds(manifests.sparkSession, "packages")
    entries = tables.keep(manifest_entries(manifests))
    lines = tables.keep(lock_lines(locks))
    roots = manifests.groupBy("repo_id").agg(F.min("root").alias("root"))
    # the importer of the file's own folder, else the one of the repository's name
    under = lines.where((F.col("k0") == "importers") & F.col("k2").isNotNull()).join(roots, "repo_id").where((F.col("k2") == ".") | (F.col("k2") == F.col("root")))
    chosen = under.groupBy("repo_id").agg(F.min(F.when(F.col("k2") == ".", 0).otherwise(1)).alias("rank"))
    own = under.join(chosen, "repo_id").where(F.when(F.col("k2") == ".", 0).otherwise(1) == F.col("rank"))
    # an entry is a version, or has one on a line below
    at = (F.col("deep") == 6) & (F.col("value") != "")
    resolved = own.where(F.col("k6").isNotNull()).groupBy("repo_id", F.col("k4").alias("scope"), F.col("k6").alias("name")).agg(F.max(F.when(at | (F.col("k8") == "version"), F.col("value"))).alias("version"))
    resolved = resolved.withColumn("version", plain_version(F.col("version")))
    direct = tables.keep(entries.where("name is not null").join(resolved, ["repo_id", "scope", "name"], "left").withColumn("source", F.when(F.col("version").isNotNull(), LOCK).otherwise("package.json")))
    locked = tables.keep(locks.where("text is not null").select("repo_id").distinct())

    below = lines.where((F.col("k0") == "snapshots") & F.col("k2").isNotNull())
    clean = F.regexp_replace("k2", "^/", "")
    name = F.regexp_extract(clean, r"^(.[^(]*)@", 1)
    version = plain_version(F.substring(clean, F.length(name) + 2, F.length(clean)))
    named = below.withColumns({"from_name": name, "from_version": version}).where("from_name <> ''")
    first = named.where("deep = 2").groupBy("repo_id", "from_name", "from_version").agg(F.min_by("k2", "pos").alias("k2"))
    snapshots = tables.keep(first)
    wanted = named.where((F.col("deep") == 6) & F.col("k4").isin("dependencies", "optionalDependencies")).join(snapshots, ["repo_id", "from_name", "from_version", "k2"], "left_semi")
    # a name in both lists is optional, and has the version of that list
    children = wanted.groupBy("repo_id", "from_name", "from_version", F.col("k6").alias("to_name")).agg(F.max(F.struct(F.col("k4").alias("scope"), F.col("value").alias("specifier"))).alias("e"))
    children = tables.keep(children.select("repo_id", "from_name", "from_version", "to_name", "e.specifier", "e.scope", plain_version(F.col("e.specifier")).alias("version")).withColumn("source", F.when(F.col("version").isNotNull(), LOCK).otherwise("package.json")))

    titles = entries.groupBy("repo_id").agg(F.max("package").alias("package")).join(roots, "repo_id").select("repo_id", F.coalesce("package", "root").alias("title"))
    edges = direct.join(titles, "repo_id").select("repo_id", F.col("title").alias("from_name"), F.lit(None).cast("string").alias("from_version"), F.col("name").alias("to_name"), "specifier", "scope", "version", "source", F.lit(0).alias("depth"))
    front = tables.keep(edges.where("version is not null").select("repo_id", F.col("to_name").alias("from_name"), F.col("version").alias("from_version")).distinct())
    # a package goes through its children once, so a round needs those only that no round had yet, of repositories that still go on: these
    # and what was reached there are written anew whenever the front has halved
    key = ["repo_id", "from_name", "from_version"]
    reached, past, rest, depth, had = front, None, children, 0, None
    while n := front.count():
        depth += 1
        if had is not None and 2 * n <= had:
            alive = front.select("repo_id").distinct()
            past = tables.keep(past.join(alive, "repo_id", "left_semi"))
            rest = tables.keep(rest.join(alive, "repo_id", "left_semi").join(past, key, "left_anti"))
        had = n if had is None or 2 * n <= had else had
        step = tables.keep(front.join(rest, key).select("repo_id", "from_name", "from_version", "to_name", "specifier", "scope", "version", "source", F.lit(depth).alias("depth")))
        edges = edges.unionByName(step)
        past = front if past is None else past.unionByName(front)  # each part is a written table
        front = tables.keep(step.where("version is not null").select("repo_id", F.col("to_name").alias("from_name"), F.col("version").alias("from_version")).distinct().join(past, key, "left_anti"))
        reached = reached.unionByName(front)
    missing = reached.join(snapshots, key, "left_anti")
    say = lambda df, *text: df.select("repo_id", F.concat(*text).alias("gap"))
    gaps = [
        say(entries.groupBy("repo_id").agg(F.max("name").alias("any"), F.max("package").alias("package")).where("any is null and package is null"), F.lit("package.json has no name and no dependencies")),
        say(entries.select("repo_id").distinct().join(locked, "repo_id", "left_anti"), F.lit(f"{LOCK} not found")),
        say(edges.where("depth = 0 and version is null").join(locked, "repo_id", "left_semi"), F.lit("No lockfile resolution for "), "to_name"),
        say(edges.where("depth > 0 and version is null"), F.lit("No lockfile resolution for "), "from_name", F.lit(" -> "), "to_name"),
        say(missing, F.lit("No lockfile snapshot for "), "from_name", F.lit("@"), "from_version"),
    ]
    all_gaps = gaps[0]
    for g in gaps[1:]:
        all_gaps = all_gaps.unionByName(g)
    return Closure(direct.select("repo_id", "name", "specifier", "scope", "version", "source"), edges, all_gaps.distinct())


def reports(manifests: DataFrame, locks: DataFrame) -> DataFrame:
    """One row per repository: package, n_dependencies, n_edges, packages (reached), depth, n_gaps, complete."""
    found = closure(manifests, locks)
    count = lambda df, *aggs: df.groupBy("repo_id").agg(*aggs)
    named = manifest_entries(manifests).groupBy("repo_id").agg(F.max("package").alias("package"), F.count("name").alias("n_dependencies"))
    edges = count(found.edges, F.count("*").alias("n_edges"), F.count_distinct(F.when(F.col("version").isNotNull(), F.struct("to_name", "version"))).alias("packages"), F.max("depth").alias("depth"))
    gaps = count(found.gaps, F.count("*").alias("n_gaps"))
    zero = {"n_edges": 0, "packages": 0, "depth": 0, "n_gaps": 0}
    return named.join(edges, "repo_id", "left").join(gaps, "repo_id", "left").fillna(zero).withColumn("complete", F.col("n_gaps") == 0)
