"""Text functions as Column expressions: classification, redaction, HTML to text, versions, languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and their languages.
LANGUAGES = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin",
    "rb": "ruby", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "cs": "c_sharp", "swift": "swift", "scala": "scala", "sh": "bash", "json": "json", "html": "html", "css": "css", "md": "markdown",
}

# What is taken out of shown text, and the word for it.
SECRETS = [
    ("aws_key", r"AKIA[0-9A-Z]{16}", "[AWS_KEY]"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    ("ipv4", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "[IP]"),
]

# Path classes in the order in which they are tried.
PATH_CLASSES = [
    ("secret", r"(^|/)(\.env[^/]*|id_rsa|.*\.pem|.*\.key)$"),
    ("generated", r"(^|/)(dist|build|generated|coverage)/|\.min\.(js|css)$"),
    ("vendor", r"(^|/)(node_modules|vendor|third_party)/"),
    ("documentation", r"\.(md|markdown|rst|txt)$|(^|/)docs/"),
    ("config", r"\.(json|ya?ml|toml|ini|cfg)$"),
]


def path_class(path: Column) -> Column:
    out = None
    for name, pattern in PATH_CLASSES:
        out = F.when(path.rlike(pattern), name) if out is None else out.when(path.rlike(pattern), name)
    return out.otherwise("source")


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def minified(text: Column) -> Column:
    """3000 characters or more with over 300 to a line."""
    n = F.char_length(text)
    breaks = n - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return (n >= 3000) & (n / (breaks + 1) > 300)


def wildcard(pattern: str) -> str:
    """A regular expression for a whole text, with * for any text and ? for one character."""
    parts = {"*": ".*", "?": "."}
    return "^" + "".join(parts.get(c) or (c if c.isalnum() or c == " " else "\\" + c) for c in pattern) + "$"


def decoded(raw: Column) -> Column:
    """Text of bytes by their mark: UTF-16 of either order, UTF-8 with or without a mark; null if the bytes are not UTF-8."""
    rest = lambda n: F.substring(raw, n + 1, (1 << 31) - 1)
    starts = lambda mark: F.startswith(F.hex(F.substring(raw, 1, 3)), F.lit(mark))
    return F.when(starts("FFFE"), F.decode(rest(2), "UTF-16LE")).when(starts("FEFF"), F.decode(rest(2), "UTF-16BE")).when(starts("EFBBBF"), F.try_validate_utf8(rest(3).cast("string"))).otherwise(F.try_validate_utf8(raw.cast("string")))


def redacted(text: Column) -> Column:
    for _, pattern, word in SECRETS:
        text = F.regexp_replace(text, pattern, word.replace("$", "\\$"))
    return text


def redaction_reasons(text: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p, _ in SECRETS])), "|")


def html_text(html: Column) -> Column:
    """Scripts and styles dropped, headings marked, links kept as markdown, tags stripped, empty lines closed up."""
    for pattern, by in HTML_RULES:
        html = F.regexp_replace(html, pattern, by)
    return F.trim(html)


# The rules of html_text, in order.
HTML_RULES = [
    (r"(?is)<(script|style)[^>]*>.*?</(script|style)>", ""),
    (r"(?is)<h[1-6][^>]*>", "\n# "),
    (r"(?is)</(h[1-6]|p|div|li|ul|tr)>", "\n"),
    (r"(?is)<a [^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>", "[$2]($1)"),
    (r"(?is)<[^>]+>", ""),
    (r"\n\s*\n+", "\n"),
]
