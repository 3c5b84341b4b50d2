"""Facts of deployment files, read by their structure.

Container files are instructions (continued lines joined); YAML is a stack of keys by indentation, so that what is a service, a dependency, a
volume or a job follows from where it stands; HCL is block headers with quoted labels. One file at a time in Arrow
batches, one pass over its lines. Names and keys come out, values of keys that hold secrets never.

Defined cases: null and empty texts, and files of other kinds, have no facts but keys that name secrets; a line is told once for
each fact; anchors, flow lists over several lines and block texts are read line by line like the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start_line long, kind string, name string, relation string, status string"
# Which files are of which kind, the words of keys that hold secrets, and the kinds of cluster objects.
FILES = {
    "container": re.compile(r"(^|/)dockerfile(\.[^/]+)?$", re.I),
    "compose": re.compile(r"(^|/)(docker-)?compose(\.[^/]+)?\.ya?ml$", re.I),
    "cluster": re.compile(r"(deployment|service|ingress|configmap|secret|statefulset|daemonset)\.ya?ml$|k8s|kubernetes", re.I),
    "hcl": re.compile(r"\.(tf|tfvars)$", re.I),
    "workflow": re.compile(r"(^|/)\.github/workflows/.*\.ya?ml$", re.I),
    "chart": re.compile(r"(^|/)charts?/|templates/|values\.ya?ml$", re.I),
}
SECRET_WORDS = ("password", "passwd", "token", "secret", "private_key", "private-key", "privatekey")
OBJECTS = {"service": "service", "ingress": "ingress", "secret": "secret_ref", "configmap": "config"}

ENTRY = re.compile(r"""(?P<key>"[^"]*"|'[^']*'|[^\s'"#\[\]{},:][^#:]*?)\s*:(?:\s+(?P<value>.*))?$""")
LABELS = re.compile(r'"([^"]*)"')
CHART_VALUE = re.compile(r"\.Values\.([\w.-]+)", re.A)
OF_SECRET = re.compile(r"(?<![a-z0-9])(" + "|".join(SECRET_WORDS) + r")\s*:", re.I)


def without_comment(line: str) -> str:
    """The line up to a # that begins a word and is not quoted."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i]
    return line


def plain(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value


def yaml_lines(lines: list[str]) -> Iterator[tuple[int, tuple[str, ...], str | None, str]]:
    """(line number, keys above, key or None for a plain list item, value) of every line; list items add no key of their own."""
    stack: list[tuple[int, str]] = []
    for number, raw in enumerate(lines, 1):
        line = without_comment(raw).rstrip()
        body = line.lstrip()
        if body in ("---", "..."):
            stack = []
        if not body or body in ("---", "...", "-"):
            continue
        depth, item = len(line) - len(body), False
        while body.startswith("- "):
            # a list may stand at the depth of its key
            while stack and stack[-1][0] > depth:
                stack.pop()
            inner = body[2:].lstrip()
            depth, body, item = depth + len(body) - len(inner), inner, True
        while stack and (stack[-1][0] >= depth and not (item and stack[-1][0] < depth)):
            stack.pop()
        above = tuple(k for _, k in stack)
        m = ENTRY.match(body)
        if m:
            key = plain(m["key"])
            yield number, above, key, plain(m["value"] or "")
            stack.append((depth, key))
        elif item:
            yield number, above, None, plain(body)


def _container(lines: list[str]):
    number = 0
    while number < len(lines):
        start, said = number, without_comment(lines[number]).strip()
        while said.endswith("\\") and number + 1 < len(lines):
            number += 1
            said = said[:-1].rstrip() + " " + lines[number].strip()
        number += 1
        word, *rest = said.split() or [""]
        rest = [w for w in rest if not w.startswith("--")]
        match word.upper():
            case "FROM" if rest:
                yield start + 1, "docker_stage", rest[2] if len(rest) > 2 and rest[1].upper() == "AS" else rest[0], "runs", "verified"
            case "EXPOSE":
                for port in rest:
                    yield start + 1, "port", port, "exposes", "verified"
            case "ENTRYPOINT" | "CMD":
                yield start + 1, "docker_stage", word, "runs", "verified"


def _compose(number: int, above: tuple, key: str | None, value: str):
    if above == ("services",) and key:
        yield number, "service", key, None, "verified"
    elif len(above) == 3 and above[0] == "services" and above[2] == "depends_on":
        yield number, "service", key or value, "depends_on", "verified"
    elif len(above) == 3 and above[0] == "services" and above[2] == "volumes":
        yield number, "volume", value if key is None else f"{key}:{value}" if key not in ("type", "source", "target") else value, "mounts", "verified"
    elif key == "depends_on" and value.startswith("["):
        for name in value.strip("[]").split(","):
            yield number, "service", plain(name), "depends_on", "verified"


def _cluster(number: int, above: tuple, key: str | None, value: str):
    if key == "kind" and not above and value:
        yield number, OBJECTS.get(value.lower(), "deployment"), value, None, "verified"
    elif key in ("name", "secretName", "configMap") and value:
        secret = any("secret" in k.lower() for k in (*above, key, value))
        yield number, "secret_ref" if secret else "config", value, "references", "candidate" if "${" in value else "verified"


def _hcl(lines: list[str]):
    for number, raw in enumerate(lines, 1):
        said = without_comment(raw).strip()
        word = said.split(" ", 1)[0]
        if word in ("resource", "data", "module") and (labels := LABELS.findall(said.split("{", 1)[0])):
            yield number, "terraform_resource", ".".join(labels if word != "module" or len(labels) > 1 else ["module", *labels]), None, "verified"


def facts_of(path: str, text: str) -> list[tuple]:
    """(start_line, kind, name, relation, status) of one file."""
    kinds = {k for k, pattern in FILES.items() if pattern.search(path)}
    lines, out = re.split(r"\r?\n", text), []
    if "container" in kinds:
        out += _container(lines)
    if "hcl" in kinds:
        out += _hcl(lines)
    if kinds & {"compose", "cluster", "workflow"}:
        for entry in yaml_lines(lines):
            if "compose" in kinds:
                out += _compose(*entry)
            if "cluster" in kinds:
                out += _cluster(*entry)
            if "workflow" in kinds and entry[1] == ("jobs",) and entry[2]:
                out.append((entry[0], "workflow_job", entry[2], None, "verified"))
    for number, raw in enumerate(lines, 1):
        if "chart" in kinds:
            out += [(number, "helm_value", name, "references", "candidate") for name in CHART_VALUE.findall(without_comment(raw))]
        if OF_SECRET.search(raw):
            key = ENTRY.match(raw.strip().removeprefix("- "))
            out.append((number, "secret_ref", plain(key["key"]) if key else "secret", "references", "verified"))
    return out


def facts(files: DataFrame) -> DataFrame:
    """SCHEMA rows of files (doc_id, file_path, text): stages and ports of container files, services, dependencies and volumes of
    compose files, cluster objects and what they refer to, infrastructure resources, workflow jobs, chart values, keys of secrets."""
    types = [pa.int64(), pa.int64(), *[pa.string()] * 4]
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, *f) for doc, path, text in zip(*(c.to_pylist() for c in batch.columns)) for f in facts_of(path or "", text or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return files.select(F.col("doc_id").cast("long"), F.col("file_path").cast("string"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def blast_radius(found: DataFrame, target: str) -> DataFrame:
    """Facts that a change of the target touches: evidence verified where a verified fact has its name, candidate where a fact is
    a candidate itself or one name holds the other; names without case, a blank target touches nothing for sure."""
    wanted = target.strip().lower()
    name = F.lower("name")
    sure = (F.col("status") == "verified") & (name == wanted) & F.lit(wanted != "")
    near = (F.col("status") == "candidate") | F.contains(name, F.lit(wanted)) | F.contains(F.lit(wanted), name)
    return found.where(sure | near).withColumn("evidence", F.when(sure, "verified").otherwise("candidate"))
