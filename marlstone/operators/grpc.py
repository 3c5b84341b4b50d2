"""Clients of remote procedures in source files, as edges to global endpoints.

Four conventions are read. A proxy: `this.x = client.getService<S>('S')`, then x.method(). A registry: `[KEY]: {serviceName: 'S'}`,
then a function that makes a client for KEY and calls a method by name. A dispatcher: any call with an object whose functionName is a
method that some class of the repository does nothing with but forward (`static m = ... => this._net.m(...)`). A getter: a
method that only returns a field made by createClient, then getter().method(), or a variable declared so in the nearest scope.

One pass over each file gives rows of facts; what belongs together is joined: variables to services, keys to registry entries,
names to the forwarders and getters of the repository, calls to declarations block by block from the inside. The last
two know no service: there the method's name decides, if one endpoint has it.

Defined cases: null and empty texts have no facts; a variable bound twice in a file has its last service; calls on
computed names, renamed or batching forwarders and getters with arguments give no edge; equal calls on one line are one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.code import Code
from marlstone.operators.knowledge import resolve_grpc
from marlstone.session import cut

SCHEMA = "repo_id string, file_path string, fact string, line int, place int, blocks array<int>, name string, value string"
DECLARES = ("const", "let", "var")


def _services(c: Code, at: int):
    """A word getService: the variable that gets a proxy, and the service."""
    if not c.is_(at, "getService") or not c.is_(at - 1, "."):
        return
    i, named = at + 1, None
    if c.is_(i, "<"):
        named, depth = c.word(i + 1), 0
        while i < len(c.tokens):
            depth += c.is_(i, "<") - c.is_(i, ">")
            i += 1
            if not depth:
                break
    if not c.is_(i, "("):
        return
    service = next((c.string(k) for k in range(i + 1, c.end(i)) if c.string(k) is not None), None) or named
    k = at
    while k > 0 and not (c.is_(k, "=") or c.is_(k, ";") or c.is_(k, "{") or c.is_(k, "}")):
        k -= 1
    if not service or not c.is_(k, "="):
        return
    while k > 0 and not (c.word(k) and (c.word(k - 1) in DECLARES or c.is_(k - 2, "this", "."))):
        if c.is_(k, ";") or c.is_(k, "{") or c.is_(k, "}"):
            # an assignment to a bare name
            return
        k -= 1
    yield "service", k, c.word(k), service


def _calls(c: Code, at: int):
    """A method called on a variable, on a field of this, or on what a getter gives."""
    if not (c.word(at) and c.is_(at - 1, ".") and c.is_(at + 1, "(")):
        return
    on = at - 2
    if c.word(on) and c.word(on) != "this":
        if not c.is_(on - 1, ".") or (c.is_(on - 2, "this", ".") and not c.is_(on - 3, ".")):
            yield "call" if not c.is_(on - 1, ".") else "field_call", at, c.word(on), c.word(at)
    while c.is_(on, ")") and on in c.match:
        start = c.match[on]
        if start == on - 1 and c.word(start - 1) and c.is_(start - 2, "."):
            yield "getter_call", at, c.word(start - 1), c.word(at)
            return
        if c.word(start - 1):
            return
        on = next((k - 1 for k in range(start + 1, on) if c.is_(k, "as")), on - 1)  # what parentheses or a cast wrap
        on -= c.is_(on, "!")


def _registry(c: Code, at: int):
    if c.is_(at, "serviceName", ":") and c.string(at + 2):
        o = c.opener[c.tokens[at].block]
        if c.is_(o - 4, "[") and c.word(o - 3) and c.is_(o - 2, "]", ":"):
            yield "registry", at, c.word(o - 3), c.string(at + 2)
    if c.is_(at, "function", "(") and c.is_(c.end(at + 1) + 1, "{"):
        k = at - 1 - (c.word(at - 1) == "async")
        if c.is_(k, ":") and c.word(k - 1):
            begin = c.end(at + 1) + 1
            inside = range(begin + 1, c.end(begin))
            key = next((c.word(i + 2) for i in inside if c.is_(i, "createGrpcClientFromRegistry", "(") and c.word(i + 2)), None)
            method = next((c.string(m) for i in inside if c.is_(i, "grpcClientCall", "(") for m in [next((m + 1 for m in range(i + 2, c.end(i + 1)) if c.is_(m, ",")), -1)] if c.string(m)), None)
            if key and method:
                yield "registry_call", k - 1, key, method


def _forwards(c: Code, at: int):
    if c.is_(at, "static") and c.word(at + 1) and c.is_(at + 2, "="):
        arrow = next((i for i in range(at + 3, len(c.tokens)) if c.is_(i, "=>") or c.is_(i, ";") or c.is_(i, "static")), len(c.tokens))
        if not c.is_(arrow, "=>"):
            return
        stop = c.end(arrow + 1) if c.is_(arrow + 1, "{") else c.expression_end(arrow + 1)
        sent = [c.word(i + 4) for i in range(arrow + 1, stop) if c.is_(i, "this", ".", "_net", ".") and c.is_(i + 5, "(")]
        if sent == [c.word(at + 1)]:
            yield "forward", at, c.word(at + 1), None
    if c.is_(at, "functionName", ":") and c.string(at + 2) and (c.is_(at + 3, ",") or c.is_(at + 3, "}")):
        o = c.opener[c.tokens[at].block]
        if c.is_(o - 1, "(") or c.is_(o - 1, ","):
            k, depth = o - 1, 0
            while k >= 0 and not (depth == 0 and c.is_(k, "(")):  # back to the call's bracket
                k = c.match.get(k, k) - 1 if c.tokens[k].text in (")", "]", "}") else k - 1
            if k > 0 and c.word(k - 1) and c.word(k - 1) not in ("if", "for", "while", "switch", "function"):
                while c.is_(k - 2, ".") and c.word(k - 3):
                    k -= 2
                yield "dispatch", k - 1, None, c.string(at + 2)


def _getters(c: Code, at: int):
    if c.word(at) and c.is_(at + 1, "(") and c.end(at + 1) == at + 2:
        o = at + 3
        if c.is_(o, ":"):
            o = next((i for i in range(o, len(c.tokens)) if c.is_(i, "{") or c.is_(i, ";")), o)
        if c.is_(o, "{", "return", "this", ".") and c.end(o) - o - c.is_(c.end(o) - 1, ";") == 5 and o in c.match:
            around = c.parent[c.tokens[o].block]
            begin, field = c.opener[around], c.word(o + 4)
            if begin >= 0 and any(c.is_(i, "this", ".", field, "=", "createClient", "(") for i in range(begin, c.end(begin))):
                yield "getter", at, c.word(at), None
    if c.word(at) in DECLARES and c.word(at + 1):
        k = at + 2
        while k < len(c.tokens) and not any(c.is_(k, x) for x in ("=", ";", "}", ",")):
            k += 1
        stop = c.expression_end(k + 1) if c.is_(k, "=") else k
        given = c.is_(stop - 2, "(", ")") and c.is_(stop - 4, ".") and c.word(stop - 3)
        yield "scope", at, c.word(at + 1), c.word(stop - 3) if given else None
    # parameters hide what is declared outside: those of a bracket before a block or an arrow
    if c.is_(at, "(") and at in c.match and not (c.word(at - 1) in ("if", "for", "while", "switch", "catch")):
        k = c.match[at] + 1
        if c.is_(k, ":"):
            k = next((i for i in range(k, len(c.tokens)) if c.is_(i, "{") or c.is_(i, "=>") or c.is_(i, ";") or c.is_(i, "(")), k)
        k += c.is_(k, "=>")
        if c.is_(k, "{"):
            for i in range(at + 1, c.match[at]):
                if c.word(i) and (c.is_(i - 1, "(") or c.is_(i - 1, ",") or c.is_(i - 1, ".")):
                    yield "scope", k, c.word(i), None


def _rules(c: Code, at: int):
    """The rules that a token can begin; strings and most marks begin none."""
    word, called = c.words[at], c.is_(at + 1, "(")
    if word is None:
        return (_getters,) if c.plain[at] == "(" else ()
    rules = [_services] if word == "getService" else []
    if called and c.is_(at - 1, "."):
        rules.append(_calls)
    if word in ("serviceName", "function"):
        rules.append(_registry)
    if word in ("static", "functionName"):
        rules.append(_forwards)
    if called or word in DECLARES:
        rules.append(_getters)
    return rules


def _facts_of(text: str) -> list[tuple]:
    """(fact, line, place, blocks, name, value) of one file."""
    c = Code(text)
    return [(fact, c.tokens[i].line, i, c.blocks(i), name, value) for at in range(len(c.tokens)) for rule in _rules(c, at) for fact, i, name, value in rule(c, at)]


def client_facts(files: DataFrame) -> DataFrame:
    """SCHEMA rows of files (repo_id, file_path, text)."""
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows), types)], names=names)
        for batch in batches:
            rows = []
            for repo, path, text in zip(*(col.to_pylist() for col in batch.columns)):
                rows += [(repo, path, *f) for f in _facts_of(text or "")]
                if len(rows) > 20_000:
                    yield packed(rows)
                    rows = []
            if rows:
                yield packed(rows)

    return files.select(F.col("repo_id").cast("string"), F.col("file_path").cast("string"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def client_calls(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, line, convention, service, method, input): calls of remote procedures. input is the endpoint's
    key where the service is known, else the bare method."""
    facts = cut(client_facts(files))
    of = lambda *kinds: facts.where(F.col("fact").isin(*kinds))
    file, repo = ["repo_id", "file_path"], ["repo_id", "name"]
    shown = lambda df, convention, service: df.select(*file, "line", F.lit(convention).alias("convention"), service.cast("string").alias("service"), F.col("value").alias("method"))
    last = lambda fact: of(fact).groupBy(*file, "name").agg(F.max_by("value", "place").alias("service"))
    proxies = shown(of("call", "field_call").where(F.col("value") != "getService").join(last("service"), [*file, "name"]), "proxy", F.col("service"))
    listed = shown(of("registry_call").join(last("registry"), [*file, "name"]), "registry", F.col("service"))
    forwarders, getters = of("forward").select(*repo).distinct(), of("getter").select(*repo).distinct()
    sent = shown(of("dispatch").drop("name").join(forwarders.withColumnRenamed("name", "value"), ["repo_id", "value"]), "dispatcher", F.lit(None))
    direct = shown(of("getter_call").join(getters, repo), "getter", F.lit(None))
    # a variable's calls meet the declarations of every block around them; the innermost one counts, getter or not
    declared = of("scope").select(*file, F.col("blocks")[0].alias("block"), "name", F.col("value").alias("getter")).groupBy(*file, "block", "name").agg(F.min("getter").alias("getter"))
    held = declared.where("getter is not null").select(*file, "name").distinct()
    around = of("call").join(held, [*file, "name"], "left_semi").select(*file, "line", "place", "name", "value", F.posexplode("blocks").alias("depth", "block"))
    nearest = around.join(declared, [*file, "block", "name"]).groupBy(*file, "line", "place", "value").agg(F.min_by(F.struct("getter"), "depth").alias("at"))
    through = shown(nearest.select(*file, "line", "value", F.col("at.getter").alias("name")).join(getters, repo), "getter", F.lit(None))
    found = proxies.unionByName(listed).unionByName(sent).unionByName(direct).unionByName(through).distinct()
    return found.withColumn("input", F.coalesce(F.concat(F.lit("grpc::"), "service", F.lit("."), F.lower("method")), F.col("method")))


def invokes(files: DataFrame, endpoints: DataFrame) -> DataFrame:
    """client_calls with what they reach among endpoints (node_id, identity_key): kind (unique, ambiguous, not_found,
    not_grpc), node_id and candidates."""
    calls = cut(client_calls(files))
    return calls.join(resolve_grpc(calls.select("input").distinct(), endpoints), "input")
