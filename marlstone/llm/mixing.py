"""Mix sources to target weights with hash-threshold histograms.

Every document gets a hash in [0, 2^60) from its id and text. A source whose target is e times its size takes each
document floor(e) times, and the rest of the target goes to the documents with the lowest hashes. The threshold is
found from sums by source and hash bucket: the boundary bucket is split again and again by the next bits until it
holds one hash value, so nothing is ever sorted. Documents that would overshoot what is left are not eligible in a
pass; `fill_passes` passes repeat the search over what is still untaken, so that a long document at the boundary does
not leave a gap.

Defined cases: null text has size 0; null source is a source of its own and comes last; rows with equal id and text
share one hash and so one decision; a document without words is repeated floor(e) times; an empty table gives an empty
result. Columns of the input other than doc_id, text and source are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import SPACE, small
from marlstone.session import cut

HASH_BITS = 60
#: Bits by which a boundary bucket is split in one step.
STEP_BITS = 12


def doc_size(text: Column) -> Column:
    """Number of words."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")).cast("long")


def doc_hash(doc_id: Column, text: Column) -> Column:
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def source_ranks(sizes: DataFrame) -> DataFrame:
    """Adds rank (0, 1, ... by code point, null last), found from sorted partitions and their row counts."""
    ordered = cut(sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    parts = ordered.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).collect()  # a row per partition
    start, starts = 0, [(-1, 0)]
    for part, n in sorted(parts):
        starts.append((part, start))
        start += n
    begun = F.create_map(*[F.lit(x) for pair in starts for x in pair])
    return ordered.select("source", "source_size", (F.element_at(begun, F.shiftright("at", 33).cast("int")) + F.col("at").bitwiseAND((1 << 33) - 1)).cast("long").alias("rank"))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Water filling: (source, source_size, target) where no target is above `most` times its source.

    Sources are capped until the level for the rest stands; each round is one sum over the sources.
    """
    ranked = cut(source_ranks(sizes).withColumn("weight", F.element_at(F.lit(list(weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")))
    budget = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        capped = F.col("weight") * level > most * F.col("source_size")
        full, weight = ranked.agg(F.sum(F.when(capped, most * F.col("source_size")).otherwise(0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        new = (budget - (full or 0)) / weight if weight else level
        if new <= level or not weight:
            break
        level = new
    return ranked.select("source", "source_size", F.least(F.col("weight") * F.lit(float(level)), (most * F.col("source_size")).cast("double")).alias("target"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, fill_passes: int = 3) -> tuple[DataFrame, int]:
    """The mix as one row per source: source_size, target, full (whole repeats) and for each pass p the most words a
    document may have to be eligible (fit_p) and the hash below which it is taken (low_p). Also the number of sources.
    """
    narrow = cut(docs.select("source", doc_size(docs["text"]).alias("size"), doc_hash(docs["doc_id"], docs["text"]).alias("hash")))
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, share, most).withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = cut(plan.withColumn("left", F.greatest(F.col("target") - F.col("full") * F.col("source_size"), F.lit(0.0))))
    n = plan.count()
    for p in range(fill_passes):
        found = _threshold(narrow, plan, n, p)
        plan = cut(plan.join(small(found, n), F.expr("source <=> found_source"), "left").drop("found_source").withColumns({f"fit_{p}": F.col("left"), f"low_{p}": F.coalesce("low", F.lit(1 << HASH_BITS)), "left": F.col("left") - F.coalesce("below", "took", F.lit(0))}).drop("low", "below", "took"))
    return plan.drop("left"), n


def eligible(p: int) -> Column:
    """Not taken in a pass before p, and not larger than what was left then."""
    before = [(F.col("size") <= F.col(f"fit_{i}")) & (F.col("hash") < F.col(f"low_{i}")) for i in range(p)]
    out = (F.col("size") > 0) & (F.col("size") <= F.col("left" if p < 0 else f"fit_{p}"))
    for b in before:
        out = out & ~b
    return out


def _threshold(narrow: DataFrame, plan: DataFrame, n: int, p: int) -> DataFrame:
    """(found_source, low, below, took): documents with a hash under low are taken; below is their sum; a source
    whose eligible documents all fit has no low, and took is their sum."""
    now = plan.withColumn(f"fit_{p}", F.col("left"))
    rows = narrow.join(small(now, n), narrow["source"].eqNullSafe(now["source"])).drop(now["source"]).where(eligible(p)).select("source", "size", "hash", "left")
    state = None
    for bits in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        if state is not None:
            rows = rows.drop("below").join(small(state.withColumnRenamed("source", "s"), n), F.expr("source <=> s") & (F.shiftright("hash", bits + STEP_BITS) == F.col("prefix"))).drop("s", "prefix", "single", "took")
        else:
            rows = rows.withColumn("below", F.lit(0).cast("long"))
        sums = rows.groupBy("source", F.shiftright("hash", bits).alias("bucket")).agg(F.sum("size").alias("sum"), F.first("left").alias("left"), F.first("below").alias("below"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        run = F.col("below") + F.sum("sum").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        cum = sums.withColumn("upto", run)
        crossing = F.col("upto") > F.col("left")
        step = cut(
            cum.groupBy("source").agg(
                F.min(F.when(crossing, F.struct("bucket", (F.col("upto") - F.col("sum")).alias("below"), (F.col("lo") == F.col("hi")).alias("single"), F.col("lo").alias("low")))).alias("at"),
                F.max("upto").alias("took"),
            ).select("source", F.col("at.bucket").alias("prefix"), F.col("at.below").alias("below"), F.coalesce("at.single", F.lit(True)).alias("single"), F.col("at.low").alias("low"), "took")
        )
        ready = step.where("single").select(F.col("source").alias("found_source"), "low", "below", F.when(F.col("low").isNull(), F.col("took")).alias("took"))
        done = ready if state is None else done.unionByName(ready)
        state = step.where("not single").select("source", "prefix", "below", "single", "took")
        if not step.where("not single").limit(1).count():
            return done
    # the last step splits to single hash values
    return done


def mixed(docs: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    """docs with the plan's columns, and size, hash and copies (how often the mix takes the row)."""
    rows = docs.select(F.struct("*").alias("row"), docs["source"].alias("source"), doc_size(docs["text"]).alias("size"), doc_hash(docs["doc_id"], docs["text"]).alias("hash"))
    named = plan.withColumnRenamed("source", "plan_source")
    joined = rows.join(small(named, n), F.expr("source <=> plan_source"), "left")
    passes = sum(c.startswith("fit_") for c in plan.columns)
    once = F.lit(False)
    for p in range(passes):
        once = once | ((F.col("size") > 0) & (F.col("size") <= F.col(f"fit_{p}")) & (F.col("hash") < F.col(f"low_{p}")))
    return joined.withColumn("copies", F.col("full") + once.cast("long"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    plan, n = plan_mix(docs, **how)
    return mixed(docs, plan, n).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: the input's columns, each row as often as the mix takes it."""
    plan, n = plan_mix(docs, **how)
    out = mixed(docs, plan, n).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("row.*")
