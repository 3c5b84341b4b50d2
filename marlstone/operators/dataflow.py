"""Flow of a variable through source text, statement by statement, and across files over verified calls.

A file's lines become an array of statements (what is assigned, what an expression names, which call takes which
names). A fold over that array carries the names that hold the value so far, so the whole trace of a file is one column
expression: nothing is exploded and no Python runs. Patterns are tried only on lines that name a held name or take parameters. Across
files a request is a small row that goes from file to file without its steps, and rows that have ended stay behind; each variable of a
file that is asked for or may be reached is traced once before, and the steps are put together at the end.

Defined cases: a null or empty text, a variable that is null or blank, or one that the text never names, gives no flow
(found is false). Names are words of letters, digits, _ and $; a name counts wherever it stands as a whole word, in comments behind
code and in strings too. Several requests may name one file. Edges of equal seq go by line, then target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import Rounds

STEP = "struct<kind:string,file_path:string,line:int,name:string,status:string,expression:string>"
STATE = f"struct<held:array<string>,steps:array<{STEP}>,gaps:array<string>>"
#: What a step says of the place where the value ends up.
SINKS = {"return": "return", "call": "call", "argument": "call", "field": "field"}

NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
CALL = rf"(?<![A-Za-z0-9_$.])({NAME}(?:\.{NAME})*)\s*\(([^)]*)\)"
UNPACKED = rf"^const\s*\{{\s*({NAME})\s*(?::\s*({NAME})\s*)?\}}\s*=\s*(.+)$"
ASSIGNED = rf"^(?:const|let|var)\s+({NAME})\s*=\s*(.+)$"
PARAMETERS = rf"^(?:async\s+)?function\s+{NAME}\s*\(([^)]*)\)"
MEMBER = rf"({NAME})\s*:\s*({NAME})"
GUARDS = r"(?i)^(?:if|while|switch|assert|invariant|validate|isvalid|guard)\b"
RETURNS, THROWS = r"^return\b", r"^(?:throw\b|(?:return\s+)?(?:new\s+)?(?:Error|reject)\b)"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({NAME})"), F.lit(1))


def statements(text: Column) -> Column:
    """array<struct<line,text,names>> of the lines that are neither empty nor comments."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda raw, i: F.struct((i + 1).alias("line"), F.trim(raw, F.lit(" \t\r\f\x0b")).alias("text")))
    told = F.filter(lines, lambda l: (l["text"] != "") & ~l["text"].startswith("//"))
    return F.transform(told, lambda l: F.struct(l["line"].alias("line"), l["text"].alias("text"), words(l["text"]).alias("names")))


def parsed(statement: Column, then) -> Column:
    """then(what each pattern finds in the statement), with each pattern tried once."""

    def one(l: Column) -> Column:
        t, value = l["text"], l["value"]
        part = lambda pattern, k, of=t: F.regexp_extract(of, pattern, k)
        within = lambda there, found: F.when(there, found).otherwise("")
        unpacks, calls = t.startswith("const") & t.contains("{"), lambda of: of.contains("(")
        unpacked = lambda k: within(unpacks, part(UNPACKED, k))
        member = lambda k: within(t.contains(":"), part(MEMBER, k))
        return F.struct(
            l["line"].alias("line"), t.alias("text"), l["names"].alias("names"),
            unpacked(1).alias("unpacked"), F.coalesce(F.nullif(unpacked(2), F.lit("")), unpacked(1)).alias("unpacked_as"), words(unpacked(3)).alias("unpacked_from"),
            within(value != "", part(ASSIGNED, 1)).alias("assigned"), value.alias("value"), words(value).alias("value_names"), within(calls(value), part(CALL, 1, value)).alias("value_call"), words(within(calls(value), part(CALL, 2, value))).alias("value_call_names"),
            within(t.contains("function"), part(PARAMETERS, 1)).alias("parameters"), member(1).alias("member"), member(2).alias("member_of"),
            F.when(t.rlike(GUARDS), "guard").when(t.rlike(RETURNS), "return").when(t.rlike(THROWS), "call").alias("leads"),
            within(calls(t), part(CALL, 1)).alias("call"), words(within(calls(t), part(CALL, 2))).alias("call_names"),
        )

    valued = F.array(F.struct(statement["line"].alias("line"), statement["text"].alias("text"), statement["names"].alias("names"), F.regexp_extract(statement["text"], ASSIGNED, 2).alias("value")))
    return F.transform(F.transform(valued, one), then)[0]


def _fold(path: Column, variable: Column):
    """One statement's effect on the state (held names, steps, gaps)."""

    def merge(state: Column, s: Column) -> Column:
        # all that a rule looks for in a statement is among its names, but for parameters
        idle = ~F.arrays_overlap(s["names"], state["held"]) & ~s["text"].contains("function")
        return F.when(idle, state).otherwise(parsed(s, lambda found: ruled(state, found)))

    def ruled(state: Column, s: Column) -> Column:
        holds = lambda names: F.arrays_overlap(names, state["held"])
        step = lambda kind, name, expression, status="verified": F.struct(F.lit(kind).alias("kind"), path.alias("file_path"), s["line"].cast("int").alias("line"), name.alias("name"), F.lit(status).alias("status"), F.trim(expression).alias("expression"))
        opaque = lambda callee: F.concat(F.lit("opaque call boundary at "), path, F.lit(":"), s["line"].cast("string"), F.lit(" ("), callee, F.lit(")"))

        def after(steps: list[Column], held: Column | None = None, gap: Column | None = None) -> Column:
            return F.struct(
                (F.concat(state["held"], F.array(held)) if held is not None else state["held"]).alias("held"),
                F.concat(state["steps"], *[F.array(x) for x in steps]).alias("steps"),
                (F.array_append(state["gaps"], gap) if gap is not None else state["gaps"]).alias("gaps"),
            ).cast(STATE)

        takes = F.array_contains(F.transform(F.split(s["parameters"], ","), lambda p: F.trim(p)), variable)
        # a parameter list is noted and the statement goes on to the later rules
        begun = F.when((s["parameters"] != "") & takes, after([step("assign", variable, s["parameters"])])).otherwise(state)
        noted = lambda kind, name: F.struct(begun["held"].alias("held"), F.array_append(begun["steps"], step(kind, name, s["text"])).alias("steps"), begun["gaps"].alias("gaps")).cast(STATE)
        argument = step("argument", s["call"], s["text"], "candidate")
        return (
            F.when((s["unpacked"] != "") & (holds(s["unpacked_from"]) | F.array_contains(state["held"], s["unpacked"])), after([step("field", s["unpacked_as"], s["text"])], s["unpacked_as"]))
            .when((s["assigned"] != "") & holds(s["value_names"]) & holds(s["value_call_names"]), after([step("assign", s["assigned"], s["value"]), step("argument", s["value_call"], s["text"], "candidate")], s["assigned"], opaque(s["value_call"])))
            .when((s["assigned"] != "") & holds(s["value_names"]), after([step("assign", s["assigned"], s["value"])], s["assigned"]))
            .when((s["member"] != "") & F.array_contains(state["held"], s["member_of"]), F.struct(F.array_append(begun["held"], s["member"]).alias("held"), F.array_append(begun["steps"], step("field", s["member"], s["text"])).alias("steps"), begun["gaps"].alias("gaps")).cast(STATE))
            .when((s["leads"] == "guard") & holds(s["names"]), noted("guard", variable))
            .when((s["leads"] == "return") & holds(s["names"]), noted("return", variable))
            .when((s["leads"] == "call") & holds(s["names"]), noted("call", variable))
            .when((s["call"] != "") & holds(s["call_names"]), F.struct(begun["held"].alias("held"), F.array_append(begun["steps"], argument).alias("steps"), F.array_append(begun["gaps"], opaque(s["call"])).alias("gaps")).cast(STATE))
            .when(holds(s["names"]) & (F.size(begun["steps"]) == 0), noted("assign", variable))
            .otherwise(begun)
        )

    return merge


def flow(path: Column, text: Column, variable: Column, most: int = 100) -> Column:
    """struct<steps, gaps, truncated> of a variable in one text."""
    name = F.trim(F.coalesce(variable, F.lit("")))
    none = F.struct(F.array(name).alias("held"), F.array().alias("steps"), F.array().alias("gaps")).cast(STATE)
    end = F.aggregate(F.when(name != "", statements(text)).otherwise(F.slice(statements(F.lit("")), 1, 0)), none, _fold(path, name))
    return F.transform(F.array(end), lambda s: F.struct(F.slice(s["steps"], 1, most).alias("steps"), F.array_distinct(s["gaps"]).alias("gaps"), (F.size(s["steps"]) >= most).alias("truncated")))[0]


def _described(flows: DataFrame) -> DataFrame:
    """Adds found, and where the value comes from and ends up."""
    first, last = F.get("steps", F.lit(0)), F.try_element_at("steps", F.lit(-1))
    sink = F.coalesce(*[F.when(last["kind"] == k, v) for k, v in SINKS.items()], F.when(last.isNotNull(), "variable"))
    of_source = F.when(first["kind"] == "return", "return").when(first["kind"].isin("call", "argument"), "call").when(first.isNotNull(), "variable")
    return flows.withColumns({"found": F.size("steps") > 0, "source_kind": of_source, "source_line": first["line"], "sink_kind": sink, "sink_file": last["file_path"], "sink_line": last["line"]})


def data_flows(files: DataFrame, requests: DataFrame, most: int = 100) -> DataFrame:
    """Flows of requests (request_id, file_path, variable) in files (file_path, text): steps (kind assign, argument, return,
    field, guard or call; verified, or candidate where a call may do anything), gaps, truncated, found, source and sink.
    A request whose file is not there is not found."""
    traced = requests.select("request_id", "file_path", "variable").join(files.select("file_path", "text"), "file_path", "left")
    traced = traced.withColumn("flow", flow(F.col("file_path"), F.col("text"), F.col("variable"), most))
    return _described(traced.select("request_id", "file_path", "variable", F.col("flow.steps").alias("steps"), F.col("flow.gaps").alias("gaps"), F.col("flow.truncated").alias("truncated")))


def flows_over_calls(files: DataFrame, requests: DataFrame, edges: DataFrame, most: int = 100, hops: int = 20) -> DataFrame:
    """data_flows that go on over edges (seq, from_file, from_line, to_file, to_variable, status).

    From a file the first edge that the request has not taken is followed if it is verified: the candidate steps of its line give way to
    the call and the steps in the target. A candidate edge, or a target without flow, ends the trace with a gap. `hops`
    bounds how many edges a request takes, and truncated tells of the cut.
    """
    nth = Window.partitionBy("from_file").orderBy("seq", "from_line", "to_file", "to_variable")
    tables, pair = Rounds(files.sparkSession, "flows"), ["file_path", "variable"]
    asked = tables.keep(requests.select("request_id", *pair).withColumn("id", F.monotonically_increasing_id()))
    # a request takes `hops` edges at most, so it never comes to a later edge of a file
    ways = tables.keep(edges.withColumn("turn", F.row_number().over(nth) - 1).where(F.col("turn") < hops).select("from_file", "turn", "from_line", "to_file", "to_variable", (F.col("status") == "verified").alias("verified")))
    pairs = asked.select(*pair).unionByName(ways.where("verified").select(F.col("to_file").alias("file_path"), F.col("to_variable").alias("variable"))).distinct()
    traces = tables.keep(data_flows(files, pairs.withColumn("request_id", F.lit(None).cast("string")), most).select(*pair, "steps", "gaps", "found"))
    found = traces.where("found").select(*pair)
    there = found.select(F.col("file_path").alias("to_file"), F.col("variable").alias("to_variable"), F.lit(True).alias("there"))
    ways = tables.keep(ways.join(there, ["to_file", "to_variable"], "left").withColumn("goes", F.coalesce(F.col("verified") & F.col("there"), F.lit(False))).drop("there"))
    now = tables.keep(asked.join(found, pair).select("id", F.col("file_path").alias("at"), F.array().cast("array<string>").alias("been")))
    taken = None
    for hop in range(hops):
        if not now.limit(1).count():
            break
        here = now.withColumn("turn", F.size(F.filter("been", lambda b: b == F.col("at")))).withColumnRenamed("at", "from_file")
        met = tables.keep(here.join(ways.where(F.col("turn") <= hop), ["from_file", "turn"]).withColumn("hop", F.lit(hop)).drop("turn"))
        now = met.where("goes").select("id", F.col("to_file").alias("at"), F.array_append("been", F.col("from_file")).alias("been"))
        taken = met.drop("been") if taken is None else taken.unionByName(met.drop("been"))
    if taken is None:
        return _described(asked.join(traces.drop("found"), pair, "left").select("request_id", *pair, *[F.coalesce(c, F.array()).alias(c) for c in ("steps", "gaps")], F.coalesce(F.size("steps") > 0, F.lit(False)).alias("truncated")))
    more = traces.where("found").select(F.col("file_path").alias("to_file"), F.col("variable").alias("to_variable"), F.col("steps").alias("more"))
    # a group holds the edges that one request has taken, `hops` at most
    gone = taken.where("goes").join(more, ["to_file", "to_variable"]).unionByName(taken.where("not goes"), allowMissingColumns=True)
    gone = gone.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("hop", "from_file", "from_line", "to_file", "to_variable", "verified", "goes", "more"))).alias("way"))
    moved = asked.join(gone, "id", "left").join(traces.select(*pair, "steps", "gaps"), pair, "left")
    none = F.struct(*[F.coalesce(F.col(c), F.array().cast(kind)).alias(c) for c, kind in (("steps", f"array<{STEP}>"), ("gaps", "array<string>"))])

    def taking(state: Column, e: Column) -> Column:
        call = F.struct(F.lit("call").alias("kind"), e["from_file"].alias("file_path"), e["from_line"].cast("int").alias("line"), e["to_variable"].alias("name"), F.lit("verified").alias("status"), F.concat(F.lit("verified call -> "), e["to_file"], F.lit(":"), e["to_variable"]).alias("expression")).cast(STEP)
        stays = lambda s: ~((s["file_path"] == e["from_file"]) & (s["line"] == e["from_line"]) & (s["status"] == "candidate"))
        gap = F.when(~F.coalesce(e["verified"], F.lit(False)), F.concat(F.lit("unverified inter-procedural edge at "), e["from_file"], F.lit(":"), e["from_line"].cast("string"))).otherwise(F.concat(F.lit("verified target source unavailable at "), e["to_file"]))
        on = F.struct(F.concat(F.filter(state["steps"], stays), F.array(call), e["more"]).alias("steps"), state["gaps"].alias("gaps"))
        end = F.struct(state["steps"].alias("steps"), F.when(gap.isNotNull(), F.array_append(state["gaps"], gap)).otherwise(state["gaps"]).alias("gaps"))
        kind = f"struct<steps:array<{STEP}>,gaps:array<string>>"
        return F.when(e["goes"], on.cast(kind)).otherwise(end.cast(kind))

    cut = F.coalesce((F.size("way") == hops) & F.element_at("way", -1)["goes"], F.lit(False))
    ended = F.when(F.col("way").isNull(), none).otherwise(F.aggregate("way", none.cast(f"struct<steps:array<{STEP}>,gaps:array<string>>"), taking))
    done = moved.select("request_id", *pair, ended.alias("end"), cut.alias("cut"))
    return _described(done.select("request_id", *pair, F.slice("end.steps", 1, most).alias("steps"), F.array_distinct("end.gaps").alias("gaps"), (F.col("cut") | (F.size("end.steps") > most)).alias("truncated")))


def mentions(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Lines that name a variable, for languages without patterns: request_id, line, kind (definition, return, call or use) and expression."""
    at = requests.join(files.select("file_path", "text"), "file_path").select("request_id", F.trim("variable").alias("variable"), F.posexplode(F.split("text", "\r?\n")).alias("pos", "text"))
    named = at.where((F.col("variable") != "") & F.array_contains(words(F.col("text")), F.col("variable")))
    said = lambda pattern, k=1: F.regexp_extract("text", pattern, k)
    defined = rf"\b(?:const|let|var)\s+({NAME})\s*=\s*(.+)"
    value = F.when(said(defined) == F.col("variable"), said(defined, 2))
    called = F.array_contains(F.regexp_extract_all("text", F.lit(rf"({NAME})\s*\(")), F.col("variable"))
    kind = F.when(value.isNotNull(), "definition").when(said(rf"\breturn\s+({NAME})") == F.col("variable"), "return").when(called, "call").otherwise("use")
    return named.select("request_id", (F.col("pos") + 1).alias("line"), kind.alias("kind"), F.trim(F.coalesce(value, "text")).alias("expression"))
