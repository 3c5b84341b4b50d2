"""Tokens of source text: words, strings, marks, each with its line and the block of braces that it stands in.

A small helper for operators that read code file by file in Arrow batches. Comments are left out and strings are one
token, so braces in them open nothing; a brace that never closes ends with the text. One pass, linear in the text.
"""

from __future__ import annotations

import re
from typing import NamedTuple

LEXEME = re.compile(r"(?P<gap>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`)|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<mark>=>|.)", re.S)
OPENING = {"(": ")", "[": "]", "{": "}"}


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    #: Number of the innermost block of braces, 0 for the file; an opening brace has the number of its block, a closing one too.
    block: int


class Code:
    """tokens; parent and opener (index of the brace) of each block; match: partner of each bracket, -1 where there is none. plain,
    words and strings are the texts of the tokens that are no strings, words only and strings only, null in between: rules look at these
    far more often than tokens are made."""

    def __init__(self, text: str):
        self.tokens: list[Token] = []
        self.parent, self.opener = [-1], [-1]
        self.match: dict[int, int] = {}
        line, block, open_at = 1, 0, []
        for m in LEXEME.finditer(text):
            value = m[0]
            if m.lastgroup != "gap":
                at = len(self.tokens)
                if value in OPENING:
                    open_at.append(at)
                    if value == "{":
                        self.parent.append(block)
                        self.opener.append(at)
                        block = len(self.parent) - 1
                inside = block
                if value in (")", "]", "}"):
                    # an unbalanced closing bracket closes nothing, unopened ones in between are given up
                    k = next((i for i in range(len(open_at) - 1, -1, -1) if OPENING[self.tokens[open_at[i]].text] == value), -1)
                    if k >= 0 and (value == "}" or not any(self.tokens[i].text == "{" for i in open_at[k + 1 :])):
                        self.match[open_at[k]], self.match[at] = at, open_at[k]
                        del open_at[k:]
                        if value == "}":
                            block = self.parent[inside := self.tokens[self.match[at]].block]
                self.tokens.append(Token(m.lastgroup, value[1:-1] if m.lastgroup == "string" else value, line, inside))
            line += value.count("\n")
        self.plain = [None if t.kind == "string" else t.text for t in self.tokens]
        self.words = [t.text if t.kind == "word" else None for t in self.tokens]
        self.strings = [t.text if t.kind == "string" else None for t in self.tokens]

    def blocks(self, at: int) -> list[int]:
        """Blocks around a token, innermost first."""
        out, b = [], self.tokens[at].block
        while b >= 0:
            out.append(b)
            b = self.parent[b]
        return out

    def is_(self, at: int, *texts: str) -> bool:
        """Whether the tokens from here on read so; strings never do."""
        return at >= 0 and tuple(self.plain[at : at + len(texts)]) == texts

    def word(self, at: int) -> str | None:
        return self.words[at] if 0 <= at < len(self.words) else None

    def string(self, at: int) -> str | None:
        return self.strings[at] if 0 <= at < len(self.strings) else None

    def end(self, at: int) -> int:
        """Index of the bracket's partner, or of the last token."""
        return self.match.get(at, len(self.tokens) - 1)

    def expression_end(self, at: int) -> int:
        """Index after an expression that begins here: at a semicolon, comma or closing bracket, or where a new line begins something else."""
        i = at
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.kind == "mark" and t.text in ";,)]}":
                return i
            if i > at and t.line > self.tokens[i - 1].line and t.kind != "mark" and self.tokens[i - 1].text not in ("=>", "=", "+", "-", "*", "/", "&", "|", "?", ":", "."):
                return i
            i = self.match.get(i, i) + 1 if t.kind == "mark" and t.text in OPENING else i + 1
        return i
