"""Rules of the knowledge model on its own columns: trust of edges, bases and freshness of branches, code versions,
upserts, imports, records with a life cycle, audit chains, and what a revision shows. Each is a composition of joins,
partial sums and column expressions; no group is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The moves that an evidence note and a finding may make.
EVIDENCE_MOVES = {"draft": ("reviewed",), "reviewed": ("verified",), "verified": ("resolved",), "resolved": ("archived",), "archived": ()}
FINDING_MOVES = {"draft": ("reproduced", "contradicted"), "reproduced": ("validated", "contradicted", "draft"), "validated": ("resolved", "contradicted"), "contradicted": ("draft", "resolved"), "resolved": ()}
# What a relative import may name, in order of preference, and the sources of emitted extensions.
EMITTED = {".js": (".ts", ".tsx", ".d.ts"), ".jsx": (".tsx",), ".mjs": (".mts",), ".cjs": (".cts",)}
EXTENSIONS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".d.ts", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def edge_trust(edges: DataFrame) -> DataFrame:
    """edges (method, provenance as JSON) with status (verified or candidate) and proof. Inferred edges, heuristics and
    conventions of a framework are candidates; provenance that is no JSON says nothing."""

    def said(key: str) -> Column:
        return F.get_json_object("provenance", f"$.{key}")

    def true(key: str) -> Column:
        return F.coalesce(~said(key).isin("", "0", "false", "null"), F.lit(False))

    convention = F.coalesce(said("frameworkConvention") == "true", F.lit(False))
    candidate = F.coalesce(F.col("method") == "INFERRED", F.lit(False)) | F.coalesce(said("proof") == "heuristic", F.lit(False)) | convention
    shown = F.when(true("runtimeObservation"), "runtime_observation").when(true("typeResolved"), "type_resolution").when(true("lspResolved"), "lsp_resolution").when(true("frameworkRegistration"), "framework_registration").otherwise("ast_exact")
    proof = F.when(convention, "framework_convention").when(candidate, "heuristic").otherwise(F.coalesce(said("proof"), shown))
    return edges.withColumns({"status": F.when(candidate, "candidate").otherwise("verified"), "proof": proof})


def markdown_places(notes: DataFrame, field: str, value: str) -> DataFrame:
    """(doc_id, start_line, end_line, start_byte) of notes (doc_id, text) in which the predicate holds: the first line
    with a line's, tag's or block's (^id) text, an open or done task, or the section whose heading holds the value, up to
    the next heading of its level or above."""
    lines = F.split("text", "\n")
    if field == "section":
        heading = F.transform(lines, lambda x, i: F.struct((i + 1).alias("n"), F.length(F.regexp_extract(x, r"^(#{1,6})\s+\S", 1)).alias("level"), F.lower(F.regexp_extract(x, r"^#{1,6}\s+(.+?)\r?$", 1)).alias("title")))
        heads = notes.select("doc_id", lines.alias("lines"), F.filter(heading, lambda h: h["level"] > 0).alias("heads"))
        heads = heads.withColumn("found", F.get(F.filter("heads", lambda h: F.contains(h["title"], F.lit(value.lower()))), F.lit(0))).where("found is not null")
        after = F.get(F.filter("heads", lambda h: (h["n"] > F.col("found")["n"]) & (h["level"] <= F.col("found")["level"])), F.lit(0))["n"]
        found = heads.select("doc_id", "lines", F.col("found.n").alias("start_line"), (F.coalesce(after, F.size("lines") + 1) - 1).alias("end_line"))
    else:
        wanted = {"block": f"^{value}", "task": {"open": "- [ ]", "done": "- [x]"}.get(value.lower(), value)}.get(field, value).lower()
        at = F.array_position(F.transform(lines, lambda x: F.contains(F.lower(x), F.lit(wanted))), True)
        found = notes.where(F.contains(F.lower("text"), F.lit(wanted))).select("doc_id", lines.alias("lines"), at.cast("int").alias("start_line")).where("start_line > 0").withColumn("end_line", F.col("start_line"))
    before = F.aggregate(F.slice("lines", F.lit(1), F.col("start_line") - 1), F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 1)
    return found.select("doc_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), before.alias("start_byte"))


def branch_bases(branches: DataFrame) -> DataFrame:
    """branches with reason, base_snapshot_id, base_commit, degraded and materialize: the branch's own prior snapshot,
    nothing for the canonical branch itself, the merge base's snapshot, its commit where the history is complete, the
    canonical snapshot as a degraded base, or none. Columns: prior_snapshot_id, prior_commit, target_branch,
    canonical_branch, merge_base_snapshot_id, merge_base_commit, canonical_snapshot_id, canonical_commit, history."""
    complete = F.coalesce(F.col("history") == "complete", F.lit(False))
    case = F.when(F.col("prior_snapshot_id").isNotNull(), 1).when(F.coalesce(F.col("target_branch") == F.col("canonical_branch"), F.lit(False)), 2).when(F.col("merge_base_snapshot_id").isNotNull(), 3).when(F.col("merge_base_commit").isNotNull() & complete, 4).when(F.col("canonical_snapshot_id").isNotNull(), 5).when(complete, 6).otherwise(7)

    def pick(*values: Column | str | bool | None) -> Column:
        out = None
        for k, v in enumerate(values, 1):
            c = v if isinstance(v, Column) else F.lit(v)
            out = F.when(F.col("case") == k, c) if out is None else out.when(F.col("case") == k, c)
        return out

    none = F.lit(None).cast("string")
    text = lambda c: F.col(c).cast("string")
    return branches.withColumn("case", case).withColumns({
        "reason": pick("prior_branch_snapshot", "canonical_master", "git_merge_base", "git_merge_base", "degraded_history", "no_base", "degraded_history"),
        "base_snapshot_id": pick(text("prior_snapshot_id"), none, text("merge_base_snapshot_id"), none, text("canonical_snapshot_id"), none, none),
        "base_commit": pick(text("prior_commit"), none, text("merge_base_commit"), text("merge_base_commit"), text("canonical_commit"), none, none),
        "degraded": F.col("case").isin(5, 7),
        "materialize": F.col("case") == 4,
    }).drop("case")


def freshness(branches: DataFrame) -> DataFrame:
    """branches (last_indexed_at, last_indexed_commit, head_commit) with stale and reason: never indexed, advanced or
    fresh; where either commit is unknown an indexed branch counts as fresh."""
    never = F.col("last_indexed_at").isNull()
    moved = F.coalesce(F.col("head_commit") != F.col("last_indexed_commit"), F.lit(False))
    return branches.withColumns({"stale": never | moved, "reason": F.when(never, "never_indexed").when(moved, "advanced").otherwise("fresh")})


def code_versions(requests: DataFrame, deployments: DataFrame, snapshots: DataFrame, branches: DataFrame) -> DataFrame:
    """(request_id, source, commit) of requests (request_id, repo_id, target_id, observed_at, log_commit,
    environment_branch): the log's own commit, the deployment that ran then (as of), the newest ready or cold snapshot,
    the environment's branch, the live branch. Deployments (target_id, repo_id, commit, deployed_from, deployed_to) meet
    requests on their keys; snapshots (repo_id, commit, state, published_at) are reduced to one a repository first."""
    ran = requests.join(deployments, ["target_id", "repo_id"]).where((F.col("deployed_from") <= F.col("observed_at")) & (F.col("deployed_to").isNull() | (F.col("deployed_to") > F.col("observed_at"))))
    ran = ran.groupBy("request_id").agg(F.max_by("commit", F.struct("deployed_from", "commit")).alias("ran"))
    newest = snapshots.where(F.col("commit").isNotNull() & F.col("state").isin("ready", "cold")).groupBy("repo_id").agg(F.max_by("commit", F.struct("published_at", "commit")).alias("newest"))
    env = branches.select("repo_id", F.col("name").alias("environment_branch"), F.lit(True).alias("has_env")).distinct()
    live = branches.where("live").select("repo_id", F.lit(True).alias("has_live")).distinct()
    all_ = requests.join(ran, "request_id", "left").join(newest, "repo_id", "left").join(env, ["repo_id", "environment_branch"], "left").join(live, "repo_id", "left")
    source = F.when(F.col("log_commit").isNotNull(), "log_commit").when(F.col("ran").isNotNull(), "deployment_record").when(F.col("newest").isNotNull(), "indexed_commit").when(F.col("has_env"), "environment_branch").when(F.col("has_live"), "live_fallback").otherwise("unresolved")
    return all_.select("request_id", source.alias("source"), F.coalesce("log_commit", "ran", "newest").alias("commit"))


def upsert_nodes(writes: DataFrame) -> DataFrame:
    """One node per (node_type, identity_key) after all writes (seq, title, meta, repo_id) in order of seq: the last title,
    the last meta that was given, the first owner that was named."""
    return writes.groupBy("node_type", "identity_key").agg(
        F.max_by("title", "seq").alias("title"),
        F.max_by("meta", F.when(F.col("meta").isNotNull(), F.col("seq"))).alias("meta"),
        F.min_by("repo_id", F.when(F.col("repo_id").isNotNull(), F.col("seq"))).alias("repo_id"),
    )


def repo_conflicts(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(incoming_id, existing_id, matched_by) of incoming repositories (id, remote, name): by id, else by remote, else by
    name in any case; 'new' where none matches. Of existing ones that share a remote or a name the last id counts."""
    by_id = existing.select("id", F.col("id").alias("same_id")).distinct()
    by_remote = existing.where("remote is not null").groupBy("remote").agg(F.max("id").alias("same_remote"))
    by_name = existing.groupBy(F.lower("name").alias("lower_name")).agg(F.max("id").alias("same_name"))
    found = incoming.withColumn("lower_name", F.lower("name")).join(by_id, "id", "left").join(by_remote, "remote", "left").join(by_name, "lower_name", "left")
    by = F.when(F.col("same_id").isNotNull(), "id").when(F.col("same_remote").isNotNull(), "remote").when(F.col("same_name").isNotNull(), "name").otherwise("new")
    return found.select(F.col("id").alias("incoming_id"), F.coalesce("same_id", "same_remote", "same_name").alias("existing_id"), by.alias("matched_by"))


def resolve_grpc(inputs: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(input, kind, node_id, candidates) of inputs against endpoints (node_id, identity_key 'grpc::Service.method' in
    lower-case method): the key itself, /pkg.Service/Method, Service.Method, or a bare method, which is ambiguous where
    several services have it."""
    raw = F.trim("input")
    parts = F.filter(F.split(raw, "/"), lambda x: x != "")
    slash, dot = F.contains(raw, F.lit("/")), F.contains(raw, F.lit("."))
    key = lambda service, method: F.when((service != "") & (method != ""), F.concat(F.lit("grpc::"), service, F.lit("."), F.lower(method)))
    by_slash = F.when(F.size(parts) >= 2, key(F.substring_index(F.get(parts, F.size(parts) - 2), ".", -1), F.get(parts, F.size(parts) - 1)))
    last = F.substring_index(raw, ".", -1)
    by_dot = key(F.substring(raw, F.lit(1), F.length(raw) - F.length(last) - 1), last)
    literal = F.startswith(raw, F.lit("grpc::"))
    asked = inputs.select("input", F.when(literal, raw).when(slash, by_slash).when(dot, by_dot).alias("key"), F.when(~literal & ~slash & ~dot, F.lower(raw)).alias("method"))
    known = endpoints.where(F.startswith("identity_key", F.lit("grpc::")))
    keys = known.groupBy(F.col("identity_key").alias("key")).agg(F.min("node_id").alias("by_key"))
    methods = known.groupBy(F.substring_index("identity_key", ".", -1).alias("method")).agg(F.min("node_id").alias("by_method"), F.count_distinct("identity_key").alias("n"))
    found = asked.join(keys, "key", "left").join(methods, "method", "left")
    kind = F.when(F.col("key").isNotNull(), F.when(F.col("by_key").isNotNull(), "unique").otherwise("not_found")).when(F.col("n") == 1, "unique").when(F.col("n") > 1, "ambiguous").otherwise("not_grpc")
    return found.select("input", kind.alias("kind"), F.coalesce("by_key", F.when(F.col("n") == 1, F.col("by_method"))).alias("node_id"), F.when(F.col("key").isNull(), F.coalesce("n", F.lit(0))).otherwise(F.col("by_key").isNotNull().cast("long")).cast("long").alias("candidates"))


def recall(memory: DataFrame, now, workspace: str | None = None, repo: str | None = None) -> DataFrame:
    """Active items (status, expires_at, confidence, updated_at, workspace_id, repo_id) that have not expired at now, within
    the scope: an item of no workspace fits every one, an item of no repository fits none. With rank by confidence, then
    the newest, then id."""
    out = memory.where((F.col("status") == "active") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now))))
    if workspace is not None:
        out = out.where(F.col("workspace_id").isNull() | (F.col("workspace_id") == workspace))
    if repo is not None:
        out = out.where(F.col("repo_id") == repo)
    return out.orderBy(F.desc("confidence"), F.desc("updated_at"), "id")


def moved(items: DataFrame, moves: dict[str, Sequence[str]]) -> DataFrame:
    """items (status, wanted, expected or null) with outcome (moved, conflict with what was expected, or invalid) and the
    status afterwards."""
    allowed = F.create_map(*[x for a, b in moves.items() for x in (F.lit(a), F.lit(list(b)).cast("array<string>"))])
    ok = F.coalesce(F.array_contains(F.element_at(allowed, F.col("status")), F.col("wanted")), F.lit(False))
    clash = F.coalesce(F.col("expected") != F.col("status"), F.lit(False))
    outcome = F.when(clash, "conflict").when(ok, "moved").otherwise("invalid")
    return items.withColumn("outcome", outcome).withColumn("status", F.when(F.col("outcome") == "moved", F.col("wanted")).otherwise(F.col("status")))


def disputed(cards: DataFrame) -> DataFrame:
    """cards (id, subject, decision, status, seq) after all were put in order of seq: a reviewed or verified card becomes
    disputed when a later one of its subject, reviewed or verified too, decides otherwise. For each subject only the two
    decisions that were put last matter, which partial sums find."""
    firm = F.col("status").isin("reviewed", "verified")
    last = cards.where(firm).groupBy("subject", "decision").agg(F.max("seq").alias("seq"))
    top = last.groupBy("subject").agg(F.max(F.struct("seq", "decision")).alias("top"))
    second = last.join(top, "subject").where("decision <> top.decision").groupBy("subject").agg(F.max("seq").alias("other"))
    found = cards.join(top, "subject", "left").join(second, "subject", "left")
    later = F.when(F.col("decision") != F.col("top.decision"), F.col("top.seq")).otherwise(F.col("other"))
    return found.withColumn("status", F.when(firm & F.coalesce(later > F.col("seq"), F.lit(False)), "disputed").otherwise(F.col("status"))).select(*cards.columns)


def citing(records: DataFrame, sources: str, changed: DataFrame, before: str, pattern: str) -> DataFrame:
    """records (id, status) whose sources, a text, name a changed key (column key) become stale if their status is
    `before`. Keys are cut out of the text by the pattern, so that they join."""
    named = records.where(F.col("status") == before).select("id", F.explode(F.array_distinct(F.regexp_extract_all(sources, F.lit(pattern), F.lit(0)))).alias("key"))
    stale = named.join(changed.select("key").distinct(), "key", "left_semi").select("id").distinct().withColumn("hit", F.lit(True))
    return records.join(stale, "id", "left").withColumn("status", F.when(F.col("hit"), "stale").otherwise(F.col("status"))).drop("hit")


def event_hash(fields: Sequence[str]) -> Column:
    """SHA-256 of an event's fields and the hash before it, each with its length so that no two rows read alike."""
    parts = [F.coalesce(F.concat(F.length(F.col(f).cast("string")).cast("string"), F.lit(":"), F.col(f).cast("string")), F.lit("-")) for f in (*fields, "previous_hash")]
    return F.sha2(F.concat_ws("|", *parts), 256)


def audit_breaks(log: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(seq, problem) of a chained log (seq without gaps, previous_hash, event_hash): rows whose previous hash is not the
    one before, or whose own hash is not that of their fields. Neighbours meet on seq, so no task holds the log."""
    after = log.select((F.col("seq") + 1).alias("seq"), F.col("event_hash").alias("before"))
    rows = log.join(after, "seq", "left")
    unlinked = ~F.col("previous_hash").eqNullSafe(F.col("before"))
    forged = F.coalesce(F.col("event_hash") != event_hash(fields), F.lit(True))
    return rows.select("seq", F.when(unlinked, "unlinked").when(forged, "forged").alias("problem")).where("problem is not null")


def merge_evidence(documents: DataFrame, observations: DataFrame, packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (topic, evidence_hash, n) and observations (topic, observation_id) after a batch of packets (topic,
    evidence_hash, observation_id; a row for each observation): (topic, status, evidence_hash, n) with status created,
    updated or duplicate_observed, n counting every observation that was sent, and the observations that were not there;
    a packet whose hash is the document's adds none."""
    sent = packets.groupBy("topic").agg(F.max("evidence_hash").alias("new_hash"), F.count("*").alias("more"))
    both = sent.join(documents, "topic", "left")
    same = F.coalesce(F.col("new_hash") == F.col("evidence_hash"), F.lit(False))
    status = F.when(F.col("n").isNull(), "created").when(same, "duplicate_observed").otherwise("updated")
    out = both.select("topic", status.alias("status"), F.col("new_hash").alias("evidence_hash"), (F.coalesce("n", F.lit(0)) + F.col("more")).cast("long").alias("n"))
    fresh = packets.join(out.where("status <> 'duplicate_observed'").select("topic"), "topic", "left_semi").select("topic", "observation_id").distinct()
    return out, fresh.join(observations, ["topic", "observation_id"], "left_anti")


def snapshot_chain(snapshots: DataFrame, start: str, most: int = 64) -> DataFrame:
    """(snapshot_id, depth) from a snapshot down its bases (snapshot_id, base_snapshot_id); a step is one lookup. A chain that comes
    back to itself, or has more than `most` snapshots, is an error: what it shows would be wrong without a word."""
    chain = [(start, 0)]
    while True:
        row = snapshots.where(F.col("snapshot_id") == chain[-1][0]).select("base_snapshot_id").first()
        if row is None or row[0] is None:
            break
        if row[0] in {s for s, _ in chain}:
            raise ValueError(f"the bases of {start} come back to {row[0]}")
        if len(chain) == most:
            raise ValueError(f"{start} has more than {most} bases")
        chain.append((row[0], len(chain)))
    return snapshots.sparkSession.createDataFrame(chain, snapshots.select("snapshot_id", F.lit(0).alias("depth")).schema)


def visible_edges(snapshots: DataFrame, refs: DataFrame, overlays: DataFrame, edges: DataFrame, start: str) -> DataFrame:
    """edges (resolution_set_id or null for global ones) that a revision shows: of refs (snapshot_id, file_path,
    resolution_set_id) along the chain the nearest of each path, unless a nearer snapshot holds the path in its overlays,
    which deletes it."""
    chain = F.broadcast(snapshot_chain(snapshots, start))  # at most 64 rows
    own = refs.join(chain, "snapshot_id")
    nearest = own.select("file_path", "depth").unionByName(overlays.join(chain, "snapshot_id").select("file_path", "depth")).groupBy("file_path").agg(F.min("depth").alias("depth"))
    shown = own.join(nearest, ["file_path", "depth"]).select("resolution_set_id").distinct()
    return edges.join(shown, "resolution_set_id", "left_semi").unionByName(edges.where("resolution_set_id is null").select("resolution_set_id", *[c for c in edges.columns if c != "resolution_set_id"]))


def scopes(requests: DataFrame, branches: DataFrame) -> DataFrame:
    """(request_id, branch, resolved_by, warning) of requests (request_id, repo_id, branch, checked_out): the branch that
    was asked for (a warning where another is checked out), else the one checked out if it is indexed, else the live one
    with a warning, of branches (repo_id, name, live). What no branch fits is unresolved."""
    has = lambda c, n: branches.select("repo_id", F.col("name").alias(c), F.lit(True).alias(n)).distinct()
    live = branches.where("live").groupBy("repo_id").agg(F.min("name").alias("live_branch"))
    all_ = requests.join(has("branch", "asked"), ["repo_id", "branch"], "left").join(has("checked_out", "indexed"), ["repo_id", "checked_out"], "left").join(live, "repo_id", "left")
    explicit = F.col("branch").isNotNull()
    by = F.when(explicit & F.col("asked"), "explicit").when(explicit, "unresolved").when(F.col("indexed"), "checkout").when(F.col("live_branch").isNotNull(), "fallback").otherwise("unresolved")
    differs = F.coalesce(F.col("branch") != F.col("checked_out"), F.lit(False))
    warning = F.when((by == "explicit") & differs, "SCOPE_DIFFERS_FROM_CHECKOUT").when((by == "fallback") & F.col("checked_out").isNotNull(), "BRANCH_NOT_INDEXED_FALLBACK").when(by == "fallback", "FALLBACK_LIVE_BRANCH").when(by == "unresolved", "SCOPE_UNRESOLVED")
    return all_.select("request_id", F.when(by == "explicit", F.col("branch")).when(by == "checkout", F.col("checked_out")).when(by == "fallback", F.col("live_branch")).alias("branch"), by.alias("resolved_by"), warning.alias("warning"))


def remove_branch(branch: str, versions: DataFrame, edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """versions (node_id, branch_id), edges (src, dst, branch_id or null) and nodes (node_id, repo_id) without a branch:
    its versions and edges go, and those of its nodes that no version and no edge holds any more."""
    left_versions = versions.where(~F.col("branch_id").eqNullSafe(F.lit(branch)))
    left_edges = edges.where(~F.col("branch_id").eqNullSafe(F.lit(branch)))
    touched = versions.where(F.col("branch_id") == branch).select("node_id").distinct()
    held = left_versions.select("node_id").unionAll(left_edges.select(F.explode(F.array("src", "dst")))).distinct()
    gone = touched.join(held, "node_id", "left_anti")
    return left_versions, left_edges, nodes.join(gone, "node_id", "left_anti")


def prune_notes(notes: DataFrame, edges: DataFrame, on_disk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """notes (node_id, path) that are still on disk (path), and edges (src, dst) without those that leave a pruned note;
    edges into one stay, as links that lead nowhere."""
    gone = notes.join(on_disk, "path", "left_anti").select(F.col("node_id").alias("src")).distinct()
    return notes.join(on_disk, "path", "left_semi"), edges.join(gone, "src", "left_anti")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, spec, target) of relative imports (doc_id, file_path, spec) against files (file_path): the first candidate
    by extension or index file that is there; null for other specifiers, for paths that leave the root, and where no
    candidate is there."""
    steps = F.concat(F.slice(F.split("file_path", "/"), F.lit(1), F.size(F.split("file_path", "/")) - 1), F.split("spec", "/"))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("inside"))

    def step(acc: Column, s: Column) -> Column:
        up = F.struct(F.slice(acc["at"], F.lit(1), F.greatest(F.size(acc["at"]) - 1, F.lit(0))).alias("at"), (acc["inside"] & (F.size(acc["at"]) > 0)).alias("inside"))
        return F.when(s.isin("", "."), acc).when(s == "..", up).otherwise(F.struct(F.concat(acc["at"], F.array(s)).alias("at"), acc["inside"].alias("inside")))

    walked = imports.where(F.startswith("spec", F.lit("."))).withColumn("walk", F.aggregate(steps, start, step)).where("walk.inside")
    base = F.array_join("walk.at", "/")
    emitted = F.array().cast("array<string>")
    for end, sources in EMITTED.items():
        stem = F.substring(base, F.lit(1), F.length(base) - len(end))
        emitted = F.when(F.endswith(base, F.lit(end)), F.array(*[F.concat(stem, F.lit(x)) for x in sources])).otherwise(emitted)
    tried = walked.select("doc_id", "spec", F.posexplode(F.concat(emitted, F.array(*[F.concat(base, F.lit(x)) for x in EXTENSIONS]))).alias("order", "file_path"))
    best = tried.join(files.select("file_path").distinct(), "file_path", "left_semi").groupBy("doc_id", "spec").agg(F.min_by("file_path", "order").alias("target"))
    return imports.select("doc_id", "spec").distinct().join(best, ["doc_id", "spec"], "left")
