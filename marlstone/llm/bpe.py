"""BPE encoding and decoding of whole texts with a published word-level vocabulary file.

A word's symbols stand in the leaves of a segment tree over adjacent pairs; a leaf's value is the pair's rank, then its
place, and each node keeps the least value below it, so that the root names the leftmost pair of lowest rank. A merge
rewrites one leaf, clears another and touches one neighbour: three walks from leaf to root. The trees of all words of a
batch that are not in the worker's bounded caches advance side by side, as rows of one array.

The file is one of the tokenizers library's kind: NFC, white space to blanks and lower case; a split pattern; byte
letters; merges with a word-end suffix; special tokens found in the raw text before all else.

Defined cases: null and empty texts give no ids and the empty text; words of any length cost n log n.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A tree's value holds a pair's rank above LEAF bits and its leaf below; a pair that has no merge has rank NONE.
LEAF, NONE = 32, 1 << 24
PLACE = (1 << LEAF) - 1
#: Words, and runs between blanks, that a worker's caches keep when a batch starts; symbols of the longest word whose
#: tree is worked on beside others.
CACHE_WORDS, TOGETHER = 250_000, 64
#: Characters of text after which an output batch is handed on.
BATCH_CHARS = 1_500_000
#: Unicode white space other than the blank.
BLANKS = [*map(chr, range(9, 14)), "\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]


def byte_letters() -> list[str]:
    """The printable stand-in for each byte: printable Latin-1 bytes stand for themselves, the others follow from 256."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens: list[str] = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = token
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {self.ids[a] << 32 | self.ids[b]: rank << LEAF for rank, (a, b) in enumerate(pairs)}
        self.merged = np.array([self.ids[a + b] for a, b in pairs], np.int64)
        self.keys = np.array(sorted(self.ranks), np.int64)
        self.key_ranks = np.array([self.ranks[k] for k in self.keys.tolist()], np.int64)
        split = next(p for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = byte_letters()
        self.inner = [self.ids.get(x) for x in letters]
        self.last = [self.ids.get(x + self.suffix) for x in letters]
        self.words: dict[str, tuple[int, ...]] = {}
        self.known: dict[str, tuple[tuple[int, ...], str, str]] = {}

    def normal(self, text: str) -> str:
        """NFC, lower case and blanks for white space; several blanks stay, which no token looks at."""
        if not text.isascii():
            # letter by letter: a sigma at a word's end is an ordinary sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        for c in BLANKS:
            if c in text:
                text = text.replace(c, " ")
        return text.lower()

    def start_ids(self, word: str) -> list[int]:
        """A symbol for every byte, the last one with the word's end; symbols that the vocabulary lacks are left out."""
        raw = word.encode()
        inner = self.inner
        ids = [inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        return [x for x in ids if x is not None] if None in ids else ids

    def merge(self, ids: list[int]) -> list[int]:
        """One word's tree in one list: leaf i of n is tree[n + i] and tree[1] the least of all."""
        n = len(ids) - 1
        if n < 1:
            return ids
        rank_of, merged, none = self.ranks.get, self.merged, NONE << LEAF
        tree = [0] * n + [rank_of(a << 32 | b, none) | i for i, (a, b) in enumerate(zip(ids, ids[1:]))]
        for node in range(n - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, n + 2)), list(range(-1, n))
        while (root := tree[1]) < none:
            i = root & PLACE
            j = after[i]
            k = after[i] = after[j]
            x = ids[i] = int(merged[root >> LEAF])
            ids[j] = -1
            changed = [(i, rank_of(x << 32 | ids[k], none) | i if k <= n else none | i)]
            if k <= n:
                before[k] = i
            if j < n:
                changed.append((j, none | j))
            if (h := before[i]) >= 0:
                changed.append((h, rank_of(ids[h] << 32 | x, none) | h))
            for leaf, value in changed:
                node = n + leaf
                tree[node] = value
                while node > 1:
                    value = min(value, tree[node ^ 1])
                    node >>= 1
                    if tree[node] == value:
                        break
                    tree[node] = value
        return [x for x in ids if x >= 0]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, shifted above the leaf's place."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], NONE << LEAF)

    def merge_all(self, words: list[list[int]], leaves: int) -> list[list[int]]:
        """The same for many words of at most `leaves` symbols (a power of two): their trees are the rows of one array,
        and each step makes one merge in every word that still has one."""
        m, none = len(words), NONE << LEAF
        sizes = np.fromiter(map(len, words), np.int64, m)
        ids = np.full((m, leaves + 1), -1, np.int64)
        ids[np.arange(leaves + 1) < sizes[:, None]] = np.fromiter(chain.from_iterable(words), np.int64, int(sizes.sum()))
        places = np.arange(leaves)
        tree = np.empty((m, 2 * leaves), np.int64)
        tree[:, leaves:] = none | places
        r, c = np.nonzero(places < sizes[:, None] - 1)
        tree[r, leaves + c] = self.rank(ids[r, c], ids[r, c + 1]) | c
        level = leaves
        while level > 1:
            np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level])
            level //= 2
        after, before = np.tile(np.arange(1, leaves + 2), (m, 1)), np.tile(np.arange(-1, leaves), (m, 1))
        # a symbol's next one is `leaves`, which is no symbol, where its word ends
        after[np.arange(m), sizes - 1] = leaves
        row = np.arange(m)
        while True:
            root = tree[row, 1]
            going = root < none
            row, root = row[going], root[going]
            if not len(row):
                break
            i = root & PLACE
            j = after[row, i]
            k = after[row, j]
            x = self.merged[root >> LEAF]
            after[row, i], ids[row, i], ids[row, j] = k, x, -1
            before[row, np.minimum(k, leaves)] = i
            h = before[row, i]
            first = h < 0
            h = np.where(first, i, h)
            tree[row, leaves + j] = none | j
            follows = self.rank(x, ids[row, k]) | i
            tree[row, leaves + h] = np.where(first, follows, self.rank(ids[row, h], x) | h)
            tree[row, leaves + i] = follows
            for node in (leaves + i, leaves + j, leaves + h):
                value = tree[row, node]
                while node[0] > 1:
                    value = np.minimum(value, tree[row, node ^ 1])
                    node = node >> 1
                    tree[row, node] = value
        keep = ids[:, :leaves] >= 0
        flat, ends = ids[:, :leaves][keep].tolist(), np.cumsum(keep.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def word_ids(self, words: list[str]) -> list[list[int]]:
        out = [self.start_ids(w) for w in words]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        low = 1
        for leaves in (4, 8, 16, 32, TOGETHER):
            at = np.flatnonzero((sizes > low) & (sizes <= leaves)).tolist()
            low = leaves
            if at:
                for n, ids in zip(at, self.merge_all([out[n] for n in at], leaves)):
                    out[n] = ids
        for n in np.flatnonzero(sizes > low).tolist():
            out[n] = self.merge(out[n])
        return out

    def runs(self, texts: list[str | None]) -> list[list[str]]:
        """Each text's runs between blanks and its special tokens (with a blank before); all of them are in `known`
        afterwards: no token goes over a blank, so a run is encoded on its own."""
        out = []
        for text in texts:
            found: list[str] = []
            for k, part in enumerate(self.splitter.split(text or "") if self.splitter else [text or ""]):
                if k % 2:
                    found.append(" " + part)
                else:
                    found.extend(filter(None, self.normal(part).split(" ")))
            out.append(found)
        for cache in (self.known, self.words):
            if len(cache) > CACHE_WORDS:
                for old in list(islice(cache, len(cache) // 2)):
                    del cache[old]
        new = set().union(*out).difference(self.known)
        parts = {run: self.pattern.findall(run) for run in new}
        words = list(set(chain.from_iterable(parts.values())).difference(self.words))
        self.words.update(zip(words, map(tuple, self.word_ids(words))))
        for token, i in self.special.items():
            parts.pop(" " + token, None)
            self.known[" " + token] = (i,), str(i), token
        for run, ws in parts.items():
            ids = self.words[ws[0]] if len(ws) == 1 else tuple(chain.from_iterable(map(self.words.__getitem__, ws)))
            self.known[run] = ids, " ".join(map(str, ids)), self.decode(ids)
        return out

    def encode_all(self, texts: list[str | None]) -> Iterator[array]:
        for runs in self.runs(texts):
            yield array("i", chain.from_iterable([self.known[r][0] for r in runs]))

    def encode(self, text: str | None) -> array:
        return next(self.encode_all([text]))

    def digest_all(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, and SHA-256 of the ids in decimals and of the decoded text, of every text."""
        for runs in self.runs(texts):
            found = list(map(self.known.__getitem__, runs))
            if not all(ids for ids, _, _ in found):  # runs of letters that the vocabulary lacks leave nothing to join
                found = [p for p in found if p[0]]
            n, decimals, tokens = zip(*found) if found else ((), (), ())
            yield sum(map(len, n)), hashlib.sha256(" ".join(decimals).encode()).hexdigest(), hashlib.sha256(" ".join(tokens).encode()).hexdigest()

    def decode(self, ids) -> str:
        """Tokens joined by blanks, as a vocabulary file without a decoder has it."""
        return " ".join(map(self.tokens.__getitem__, ids))


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The worker's own copy, loaded once."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def portions(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of consecutive rows, about BATCH_CHARS characters each."""
    start, size, texts = 0, 0, []
    for i, value in enumerate(column):
        texts.append(value.as_py())
        size += len(texts[-1] or "")
        if size >= BATCH_CHARS or i == len(column) - 1:
            yield start, texts
            start, size, texts = i + 1, 0, []


def encode(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] | None = None, text: str = "text", decoded: bool = True) -> DataFrame:
    """docs' columns in `keep` (default all) with ids array<int> and, if wanted, decoded (the text read back from ids).

    Map-only: batches go through the workers and are handed on in pieces of about BATCH_CHARS characters.
    """
    path = path or default_path()
    names = [c for c in (keep if keep is not None else docs.columns) if c not in ("ids", "decoded")]
    source = docs.select(F.struct(*[docs[c] for c in names]).alias("row") if names else F.lit(None).alias("row"), docs[text].cast("string").alias("text"))
    schema = T.StructType([source.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)] + [T.StructField("decoded", T.StringType(), False)] * decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for start, texts in portions(batch.column(1)):
                ends, flat, back = [0], array("i"), []
                for ids in vocab.encode_all(texts):
                    flat.extend(ids)
                    ends.append(len(flat))
                    if decoded:
                        back.append(vocab.decode(ids))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(memoryview(flat) if len(flat) else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), lists] + [pa.array(back, pa.string())] * decoded, names=["row", "ids"] + ["decoded"] * decoded)

    out = source.mapInArrow(run, schema)
    return out.select(*(["row.*"] if names else []), "ids", *["decoded"] * decoded)


def encoded_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, taken where the ids are."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for start, texts in portions(batch.column(1)):
                n, ids, back = zip(*vocab.digest_all(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return source.mapInArrow(run, schema)
