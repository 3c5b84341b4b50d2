"""Definitions of source files: qualified names, signatures, spans and hashes of bodies that a new name does not change.

Files are cut into definitions by patterns and by braces or indentation, one file at a time in Arrow batches; braces in
strings and comments are counted like any other. Results are rows, so nothing but the file at hand is held.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What opens a definition. Names: kind and name.
BRACED = re.compile(r"^\s*(?:export\s+|default\s+|abstract\s+|public\s+|private\s+|protected\s+|static\s+|async\s+)*(?:(?P<kind>function|class|interface|enum)\s+(?P<name>\w+)|(?P<method>(?!if\b|for\b|while\b|switch\b|catch\b|return\b)\w+)\s*\([^;{]*\)\s*(?::[^;{]+)?\{)")
INDENTED = re.compile(r"^\s*(?:async\s+)?(?P<kind>def|class)\s+(?P<name>\w+)")
PARAMETERS = re.compile(r"\(([^)]*)\)")
SCHEMA = "doc_id long, qualified_name string, kind string, signature string, start_line long, end_line long, body_hash string"


def _end(lines: list[str], at: int, indented: bool) -> int:
    """Index of a definition's last line."""
    if indented:
        depth = len(lines[at]) - len(lines[at].lstrip())
        last = at
        for i in range(at + 1, len(lines)):
            if lines[i].strip():
                if len(lines[i]) - len(lines[i].lstrip()) <= depth:
                    break
                last = i
        return last
    level, opened = 0, False
    for i in range(at, len(lines)):
        for c in lines[i]:
            if c == "{":
                level, opened = level + 1, True
            elif c == "}":
                level -= 1
            if opened and level == 0:
                return i
        if not opened and lines[i].rstrip().endswith(";"):
            return i
    return len(lines) - 1


def definitions(path: str, text: str) -> list[tuple]:
    """Rows of SCHEMA without doc_id. Names that one scope has twice carry their parameters, without blanks."""
    lines, indented = text.split("\n"), path.endswith(".py")
    found, open_scopes = [], []
    for at, line in enumerate(lines):
        m = (INDENTED if indented else BRACED).match(line)
        if not m:
            continue
        while open_scopes and open_scopes[-1][1] < at:
            open_scopes.pop()
        groups = m.groupdict()
        name = groups["name"] or groups["method"]
        kind = groups["kind"] or "method"
        end = _end(lines, at, indented)
        body = "\n".join(lines[at : end + 1])
        plain = re.sub(rf"\b{re.escape(name)}\b", "\\\\0", body)
        parameters = PARAMETERS.search(line)
        found.append((".".join([*(s for s, _ in open_scopes), name]), kind, line.strip()[:200], at + 1, end + 1, hashlib.sha256(plain.encode()).hexdigest(), re.sub(r"\s+", "", parameters[0]) if parameters else ""))
        if kind in ("class", "interface", "enum") or indented:
            open_scopes.append((name, end))
    many = Counter(f[0] for f in found)
    return [((f[0] + f[6] if many[f[0]] > 1 else f[0]), *f[1:6]) for f in found]


def symbols(files: DataFrame) -> DataFrame:
    """SCHEMA rows of files (doc_id, file_path, text); null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        types = [{"long": pa.int64(), "string": pa.string()}[c.split(" ")[1]] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = [(doc, *d) for doc, path, text in zip(*(c.to_pylist() for c in batch.columns)) if text for d in definitions(path or "", text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return files.select(F.col("doc_id").cast("long"), "file_path", "text").mapInArrow(run, SCHEMA)
