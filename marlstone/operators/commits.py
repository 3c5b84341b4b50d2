"""Merge bases and distances of branches over exported commits, without a closure of the whole history.

Each pair of heads paints its ancestors with two flags, left and right, a step of parents a round for all pairs at once. A
commit that has both flags is in common, and what is below it is too, so it goes on only as far as it can still correct
another: while its generation is above that of the deepest commit of the pair that has one flag. When nothing is left to go on,
flags are final: commits with one flag are ahead or behind, and the merge bases are common commits that no painted common
commit has as a parent.

The generation of a commit is one more than the greatest of its parents'. `generations` works them out a level a round, beginning from what is
known: they are stored with the commits, and new exports cost as many rounds as they are deep.

Defined cases: a parent that is not in the table is missing history: what depends on it is told as such, and ahead and behind
are null; heads that are null or unknown give state missing_head; equal heads are their own base; unrelated ones have none. Of several
bases (crossed merges) all are listed, and the first is that of the highest generation, then the least sha. Repeated commits count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import new_folder, removed, stored

LEFT, RIGHT = 1, 2


def parent_edges(commits: DataFrame) -> DataFrame:
    """(repo_id, sha, parent) of commits (repo_id, sha, parents)."""
    return commits.select("repo_id", "sha", F.explode(F.array_distinct("parents")).alias("parent")).where("parent is not null").distinct()


def generations(commits: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(repo_id, sha, generation): commits without parents in the table have generation 1. known: rows of an earlier call.
    Commits on a cycle, which no history has, get none."""
    folder, k = new_folder(commits.sparkSession, "generations"), 0
    edges = stored(parent_edges(commits).join(commits.select("repo_id", F.col("sha").alias("parent")).distinct(), ["repo_id", "parent"], "left_semi"), f"{folder}/edges")
    all_ = commits.select("repo_id", "sha").distinct()
    done = known.select("repo_id", "sha", "generation") if known is not None else None
    open_ = all_ if done is None else all_.join(done, ["repo_id", "sha"], "left_anti")
    waits = edges if done is None else edges.join(done, ["repo_id", "sha"], "left_anti")
    # a commit is numbered when the last of its parents is: it counts down what it waits for, then tells its children. It holds them itself,
    # so that a round moves what is told and the commits that still wait, and neither edges nor what is done
    kids = waits.groupBy("repo_id", F.col("parent").alias("sha")).agg(F.collect_list(F.col("sha")).alias("kids"))  # the children of one commit
    left = open_.join(waits.groupBy("repo_id", "sha").agg(F.count("*").alias("waits")), ["repo_id", "sha"], "left").join(kids, ["repo_id", "sha"], "left")
    left = stored(left.select("repo_id", "sha", F.coalesce("waits", F.lit(0)).alias("waits"), F.lit(0).cast("long").alias("most"), "kids"), f"{folder}/0")
    numbered = (F.col("most") + 1).alias("generation")
    news = left.where("waits = 0")
    told = news.select("repo_id", F.explode("kids").alias("sha"), numbered)
    if done is not None:
        told = told.unionByName(done.select("repo_id", F.col("sha").alias("parent"), "generation").join(waits, ["repo_id", "parent"]).select("repo_id", "sha", "generation"))
    reached = news.select("repo_id", "sha", numbered)
    reached = reached if done is None else done.unionByName(reached)
    while True:
        met = told.groupBy("repo_id", "sha").agg(F.count("*").alias("met"), F.max("generation").alias("of"))
        k += 1
        step = left.where("waits > 0").join(met, ["repo_id", "sha"], "left")
        left = stored(step.select("repo_id", "sha", (F.col("waits") - F.coalesce("met", F.lit(0))).alias("waits"), F.greatest("most", F.coalesce("of", F.lit(0))).alias("most"), "kids"), f"{folder}/{k}")
        news = left.where("waits = 0")
        if not news.limit(1).count():
            return reached
        told = news.select("repo_id", F.explode("kids").alias("sha"), numbered)
        reached = reached.unionByName(news.select("repo_id", "sha", numbered))


def merge_bases(commits: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, merge_base, merge_bases, ahead, behind, state) of pairs (pair_id, repo_id, head, base) over commits (repo_id,
    sha, parents, generation): ahead counts commits of head that base lacks. state is complete, missing_history or missing_head."""
    folder, k = new_folder(commits.sparkSession, "merge-bases"), 0
    edges = parent_edges(commits)
    known = stored(commits.select("repo_id", "sha", "generation").dropDuplicates(["repo_id", "sha"]), f"{folder}/known")
    # a parent that is not there has no generation
    ways = stored(edges.join(known.select("repo_id", F.col("sha").alias("parent"), F.col("generation").alias("parent_generation")), ["repo_id", "parent"], "left"), f"{folder}/ways")
    heads = pairs.select("pair_id", "repo_id", F.col("head").alias("sha"), F.lit(LEFT).alias("flags")).unionByName(pairs.select("pair_id", "repo_id", F.col("base").alias("sha"), F.lit(RIGHT).alias("flags")))
    begun = heads.join(known, ["repo_id", "sha"])
    painted = stored(begun.groupBy("pair_id", "repo_id", "sha").agg(F.bit_or("flags").alias("flags"), F.max("generation").alias("generation"), F.lit(True).alias("new")), f"{folder}/0")
    # pairs that have nothing left to go on leave the loop, and so do the ways of repositories without a pair in it
    one_flag, parts, near, had = F.col("flags") < LEFT + RIGHT, [], ways, None
    while True:
        of_pair = painted.groupBy("pair_id").agg(F.min(F.when(one_flag, F.col("generation"))).alias("deepest"), F.max(F.col("new") & one_flag).alias("single"), F.max(F.when(F.col("new") & ~one_flag, F.col("generation"))).alias("top"))
        of_pair = of_pair.select("pair_id", "deepest", (F.col("single") | F.coalesce(F.col("top") > F.col("deepest"), F.lit(False))).alias("active"))
        goes = F.col("new") & (one_flag | F.coalesce(F.col("generation") > F.col("deepest"), F.lit(False)))
        told = stored(painted.join(of_pair, "pair_id").select("pair_id", "repo_id", "sha", "flags", "generation", "new", goes.alias("goes"), "active"), f"{folder}/told-{k}")
        removed(commits.sparkSession, f"{folder}/{k}")
        parts.append(told.where("not active").select("pair_id", "repo_id", "sha", "flags", "generation"))
        going = told.where("goes").select("pair_id", "repo_id", "sha", "flags")
        now = going.count()
        if not now:
            break
        if had is not None and 2 * now <= had:
            near = stored(near.join(told.where("active").select("repo_id").distinct(), "repo_id", "left_semi"), f"{folder}/ways-{k}")
        had = now if had is None or 2 * now <= had else had
        step = going.join(near, ["repo_id", "sha"]).groupBy("pair_id", "repo_id", F.col("parent").alias("sha")).agg(F.bit_or("flags").alias("more"), F.max("parent_generation").alias("of"))
        # what did not go on yet stays new: a deeper commit with one flag may come later
        both = told.where("active").join(step, ["pair_id", "repo_id", "sha"], "full")
        flags = F.coalesce("flags", F.lit(0)).bitwiseOR(F.coalesce("more", F.lit(0)))
        gained = flags != F.coalesce("flags", F.lit(0))
        k += 1
        painted = stored(both.select("pair_id", "repo_id", "sha", flags.alias("flags"), F.coalesce("generation", "of").alias("generation"), (gained | (F.coalesce("new", F.lit(False)) & ~F.coalesce("goes", F.lit(False)))).alias("new")), f"{folder}/{k}")
    painted = parts[0]
    for part in parts[1:]:
        painted = painted.unionByName(part)
    common = painted.where(F.col("flags") == LEFT + RIGHT).where("generation is not null")
    inner = common.select("pair_id", "repo_id", "sha").join(ways, ["repo_id", "sha"]).select("pair_id", "repo_id", F.col("parent").alias("sha")).distinct()
    best = common.join(inner, ["pair_id", "repo_id", "sha"], "left_anti").groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("generation")).alias("g"), "sha"))).alias("best"))
    one = lambda flag: F.sum(((F.col("flags") == flag) & F.col("generation").isNotNull()).cast("long"))
    counts = painted.groupBy("pair_id").agg(one(LEFT).alias("ahead"), one(RIGHT).alias("behind"), F.max(F.col("generation").isNull()).alias("cut"))
    there = begun.groupBy("pair_id").agg(F.bit_or("flags").alias("there"))
    found = pairs.select("pair_id").join(there, "pair_id", "left").join(counts, "pair_id", "left").join(best, "pair_id", "left")
    state = F.when(F.coalesce("there", F.lit(0)) < LEFT + RIGHT, "missing_head").when(F.col("cut"), "missing_history").otherwise("complete")
    whole = lambda c: F.when(F.col("state") == "complete", F.col(c))
    bases = F.when(F.col("state") == "missing_head", F.array().cast("array<string>")).otherwise(F.coalesce(F.transform("best", lambda b: b["sha"]), F.array().cast("array<string>")))
    return found.withColumn("state", state).select("pair_id", F.get(bases, F.lit(0)).alias("merge_base"), bases.alias("merge_bases"), whole("ahead").alias("ahead"), whole("behind").alias("behind"), "state")


def default_branches(refs: DataFrame, configured: DataFrame) -> DataFrame:
    """(repo_id, branch, source) of refs (repo_id, kind local or remote, name, target): the configured branch (repo_id, branch) where it
    is a local one, else what the remote's HEAD names, else main, else master; repositories without any have null and explicit_base_required."""
    local = refs.where("kind = 'local'").groupBy("repo_id").agg(F.collect_set("name").alias("names"))  # branches of one repository
    head = refs.where("kind = 'remote' and name like '%/HEAD'").groupBy("repo_id").agg(F.min("target").alias("target"))
    named = refs.select("repo_id").distinct().join(local, "repo_id", "left").join(configured.groupBy("repo_id").agg(F.min("branch").alias("configured")), "repo_id", "left").join(head, "repo_id", "left")
    has = lambda c: F.coalesce(F.array_contains("names", c), F.lit(False))
    short = F.regexp_replace("target", "^[^/]+/", "")
    choice = [("configured", "config", has(F.col("configured"))), (short, "remote_head", F.col("target").isNotNull()), (F.lit("main"), "local_main", has(F.lit("main"))), (F.lit("master"), "local_master", has(F.lit("master")))]
    branch, source = F.lit(None).cast("string"), F.lit("explicit_base_required")
    for value, name, holds in reversed(choice):
        value = F.col(value) if isinstance(value, str) else value
        branch, source = F.when(holds, value).otherwise(branch), F.when(holds, name).otherwise(source)
    return named.select("repo_id", branch.alias("branch"), source.alias("source"))


def bases_to_build(resolutions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Commits that need a snapshot before their children: distinct (repo_id, base_commit) of resolutions (repo_id, head_commit,
    base_commit, materialize) that no snapshot (repo_id, commit) has; a head that is its own base needs none."""
    wanted = resolutions.where(F.col("materialize") & F.col("base_commit").isNotNull() & ~F.col("base_commit").eqNullSafe(F.col("head_commit")))
    return wanted.select("repo_id", "base_commit").distinct().join(snapshots.select("repo_id", F.col("commit").alias("base_commit")), ["repo_id", "base_commit"], "left_anti")
