"""References of source files to symbols, rung by rung, as edges.

Every rung is a count and a least id found by joins on names, never a list of candidates: symbols of the own file, the one of that
qualified name, those in the file and its imports, those of the repository. The ladder is then one expression a reference. A name
that half the repository has costs one row, and a reference meets as many rows as its file has imports.

Defined cases: a reference without enclosing symbol, or of another kind, is unresolved; an edge to itself is never made, and
the enclosing symbol is no candidate; of equally good candidates the least id is taken, with confidence 1/N, from 2 up to
MOST_BARE; repeated symbols count once. Without a table of imports (None) names are looked for in the repository as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More candidates than this for a bare name are none.
MOST_BARE = 6
EDGES = {"call": "calls", "type": "references", "jsx-component": "renders", "jsx-callback": "invokes_dynamic"}
# Names that say nothing by themselves, and objects of the platform whose members are no symbols of a repository.
GENERIC = """
get set has add remove delete update create find list map filter reduce forEach some every includes push pop shift unshift concat join slice splice
log error warn info debug trace then catch finally next emit on off once subscribe toString valueOf init run execute handle call apply bind record
send start stop close open load save read write parse format validate build of from to
""".split()  # noqa: SIM905
PLATFORM = """
Array ArrayBuffer Atomics BigInt Boolean Buffer console crypto Date Error Intl JSON Map Math Number Object Promise Proxy Reflect RegExp Set String
Symbol WeakMap WeakSet process global globalThis
""".split()  # noqa: SIM905


def bare(name: Column) -> Column:
    """What follows the last dot or double colon."""
    return F.substring_index(F.substring_index(name, "::", -1), ".", -1)


def _two(symbols: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, one, two): number of symbols and the two least ids."""
    least = symbols.groupBy(*keys).agg(F.count("*").alias("n"), F.min("symbol_id").alias("one"))
    second = symbols.join(least.select(*keys, "one"), list(keys)).where("symbol_id <> one").groupBy(*keys).agg(F.min("symbol_id").alias("two"))
    return least.join(second, list(keys), "left")


def resolved(refs: DataFrame, symbols: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(ref_id, src, dst, edge_type, method, confidence, rung) of refs (ref_id, repo_id, file_path, kind, raw_name, receiver,
    src) over symbols (symbol_id, repo_id, file_path, qualified_name, name) and imports (repo_id, file_path, imported). rung
    is same_file, qualified, imported, unique, guess, or why there is no edge: no_source, platform, ambiguous, unscoped,
    generic, unknown."""
    symbols = symbols.select("symbol_id", "repo_id", "file_path", "qualified_name", "name").distinct()
    asked = refs.where(F.col("kind").isin(*EDGES)).withColumn("name", bare(F.col("raw_name")))
    known = symbols.select("symbol_id", F.col("repo_id").alias("src_repo"), F.col("name").alias("src_name"), F.col("file_path").alias("src_file"))

    own = _two(symbols, "repo_id", "file_path", "name").select("repo_id", "file_path", "name", F.col("n").alias("own_n"), F.col("one").alias("own_one"))
    exact = symbols.groupBy("repo_id", F.col("qualified_name").alias("raw_name")).agg(F.count_distinct("symbol_id").alias("q_n"), F.min("symbol_id").alias("q_one")).where("q_n = 1").drop("q_n")
    everywhere = _two(symbols, "repo_id", "name").select("repo_id", "name", F.col("n").alias("all_n"), F.col("one").alias("all_one"), F.col("two").alias("all_two"))
    files = asked.select("repo_id", "file_path", "name").distinct()
    scopes = files.select("repo_id", "file_path", "name", F.col("file_path").alias("scope"))
    if imports is not None:
        reach = imports.select("repo_id", "file_path", F.col("imported").alias("scope")).where("scope <> file_path").distinct()
        scopes = scopes.unionByName(files.join(reach, ["repo_id", "file_path"]))
    near = scopes.join(symbols.select("symbol_id", "repo_id", F.col("file_path").alias("scope"), "name"), ["repo_id", "scope", "name"])
    near = _two(near, "repo_id", "file_path", "name").select("repo_id", "file_path", "name", F.col("n").alias("near_n"), F.col("one").alias("near_one"), F.col("two").alias("near_two"))
    met = asked.join(own, ["repo_id", "file_path", "name"], "left").join(exact, ["repo_id", "raw_name"], "left").join(near, ["repo_id", "file_path", "name"], "left").join(everywhere, ["repo_id", "name"], "left").join(known, F.col("src") == F.col("symbol_id"), "left")

    if imports is None:
        met = met.withColumn("seen", F.lit(False))
    else:
        met = met.join(reach.select("repo_id", "file_path", F.col("scope").alias("src_file"), F.lit(True).alias("seen")), ["repo_id", "file_path", "src_file"], "left")
    # the enclosing symbol itself is no candidate, wherever it stands
    of_name = F.coalesce((F.col("src_repo") == F.col("repo_id")) & (F.col("src_name") == F.col("name")), F.lit(False))
    in_scope = of_name & (F.coalesce("seen", F.lit(False)) | F.coalesce(F.col("src_file") == F.col("file_path"), F.lit(False)))
    count = lambda c, holds: F.coalesce(c, F.lit(0)) - holds.cast("int")
    other = lambda a, b: F.when(F.col(a) == F.col("src"), F.col(b)).otherwise(F.col(a))
    all_n, near_n = count(F.col("all_n"), of_name), count(F.col("near_n"), in_scope)
    jsx = F.startswith("kind", F.lit("jsx"))
    local = (F.coalesce("own_n", F.lit(0)) == 1) & (F.col("own_one") != F.col("src"))
    owned = ((F.col("kind") == "call") & F.coalesce(F.col("receiver") != "", F.lit(False))) | (F.col("kind") == "type")
    platform = (F.col("kind") == "call") & F.coalesce(F.regexp_extract(F.trim("receiver"), r"^([^.\[]*)", 1).isin(*PLATFORM), F.lit(False))
    written_out = F.contains("raw_name", F.lit(".")) | F.contains("raw_name", F.lit("::"))
    scoped = imports is not None
    exact_counts = F.col("q_one").isNotNull() & (F.col("q_one") != F.col("src")) & (jsx | F.lit(not scoped) | written_out | ~owned)
    exact_is_self = F.coalesce(F.col("q_one") == F.col("src"), F.lit(False)) & ~jsx & (F.lit(not scoped) | written_out | ~owned)
    rung = (
        F.when(F.col("src").isNull(), "no_source")
        .when(local, "same_file")
        .when(platform & ~jsx, "platform")
        .when(exact_counts, "qualified")
        .when(exact_is_self, "itself")
        .when(near_n == 1, "imported")
        .when(jsx, F.when((all_n == 1) & F.lit(not scoped), "unique").otherwise("ambiguous"))
        .when(near_n > 1, "ambiguous")
        .when(owned & F.lit(scoped), "unscoped")
        .when(F.col("name").isin(*GENERIC), "generic")
        .when(all_n == 1, "unique")
        .when(all_n.between(2, MOST_BARE), "guess")
        .otherwise(F.when(all_n == 0, "unknown").otherwise("ambiguous"))
    )
    out = met.select("*", rung.alias("rung"), all_n.alias("candidates"))
    dst = F.when(F.col("rung") == "same_file", F.col("own_one")).when(F.col("rung") == "qualified", F.col("q_one")).when(F.col("rung") == "imported", other("near_one", "near_two")).when(F.col("rung").isin("unique", "guess"), other("all_one", "all_two"))
    edge_type = F.element_at(F.create_map(*[F.lit(x) for kv in EDGES.items() for x in kv]), F.col("kind"))
    inferred = jsx | (F.col("rung") == "guess")
    confidence = F.when(dst.isNull(), None).when(jsx, 0.5).when(F.col("rung") == "guess", 1 / F.col("candidates"))
    return out.select("ref_id", "src", dst.alias("dst"), edge_type.alias("edge_type"), F.when(dst.isNotNull(), F.when(inferred, "INFERRED").otherwise("EXTRACTED")).alias("method"), confidence.alias("confidence"), "rung")


def second_pass(found: DataFrame, refs: DataFrame, imports: DataFrame) -> DataFrame:
    """Names worth a second pass once more files are indexed: distinct (repo_id, file_path, name) of references that no symbol
    answered, in files that import others of the repository."""
    left = found.where("rung in ('unknown', 'unscoped', 'generic')").select("ref_id").join(refs, "ref_id")
    return left.select("repo_id", "file_path", bare(F.col("raw_name")).alias("name")).distinct().join(imports.select("repo_id", "file_path").distinct(), ["repo_id", "file_path"], "left_semi")
