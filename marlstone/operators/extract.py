"""Text to facts: links, tags, properties, channels, endpoints, identifiers, symbols; one row of facts per match.

Patterns run as built-in expressions over exploded lines; nothing here needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of extracted facts.
PATTERNS = {
    "wikilink": r"!?\[\[([^\]|#]+)",
    "tag": r"(?:^|\s)#([A-Za-z][A-Za-z0-9_/-]*)",
    "env": r"process\.env\.([A-Z_][A-Z0-9_]*)",
    "throws": r"throw new ([A-Za-z_][A-Za-z0-9_]*)",
    "log_site": r"(?:logger|console)\.(?:log|info|warn|error|debug)\(\s*['\"]([^'\"]*)['\"]",
    "endpoint": r"@(Get|Post|Put|Delete|Patch)\(",
    "rpc": r"rpc\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(",
    "publishes": r"\.(?:emit|publish|send)\(\s*['\"]([^'\"]+)['\"]",
    "subscribes": r"\.(?:on|subscribe)\(\s*['\"]([^'\"]+)['\"]",
    "definition": r"(?:function|class|interface|def|enum)\s+([A-Za-z_][A-Za-z0-9_]*)",
    "import": r"(?:from|require\()\s*['\"]([^'\"]+)['\"]",
    "image": r"(?:^|\s)image:\s*([^\s]+)",
}


def lines(files: DataFrame) -> DataFrame:
    """(doc_id, line_number, line) of each text."""
    return files.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).cast("long").alias("line_number"), "line")


def facts(files: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(doc_id, line_number, kind, value): every match of the patterns, line by line."""
    def tagged(kind: str) -> Column:
        return F.transform(F.regexp_extract_all("line", F.lit(PATTERNS[kind]), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = [tagged(k) for k in kinds or PATTERNS]
    return lines(files).select("doc_id", "line_number", F.explode(F.concat(*found)).alias("fact")).select("doc_id", "line_number", "fact.kind", "fact.value")


def resolve_refs(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref_id, tier, candidates) of references (ref_id, doc_id, name) against symbols (doc_id, name): same file first, then
    a unique bare name, then up to six candidates of confidence 1/N; else unresolved. Set-based, so no second pass."""
    own = symbols.select("doc_id", "name", F.lit(True).alias("own")).distinct()
    total = symbols.groupBy("name").agg(F.count("*").alias("n"))
    found = refs.join(own, ["doc_id", "name"], "left").join(total, "name", "left")
    tier = F.when(F.col("own"), "same_file").when(F.col("n") == 1, "unique").when(F.col("n") <= 6, "candidates").otherwise("unresolved")
    return found.select("ref_id", tier.alias("tier"), F.coalesce("n", F.lit(0)).cast("long").alias("candidates"))


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Windows of `size` characters that overlap by `overlap`; an empty text has none."""
    step = size - overlap
    n = F.char_length(text)
    starts = F.sequence(F.lit(1), F.greatest(n - overlap, F.lit(1)), F.lit(step))
    return F.when(n > 0, F.transform(starts, lambda s: F.substring(text, s, F.lit(size)))).otherwise(F.array().cast("array<string>"))
