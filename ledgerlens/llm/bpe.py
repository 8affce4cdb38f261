"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token of n symbols has n-1 adjacent pairs. The tree's leaf i holds (rank, i) of the pair that
starts at symbol i, or infinity where the pair is no merge or its left symbol is gone. The root is
the lowest rank, leftmost at ties. A merge changes three leaves, each repaired along one path to the
root, so encoding costs O(n log n) and stops when the root is infinite.

Many pre-tokens of one tree size are processed together, one tree per row of a numpy matrix; those
of over LONG pairs get a tree of their own, in a flat list.

Edge cases: null and empty texts, and texts of white space only, have no tokens (the digest of the
empty string); special-token strings in a text are that token, as in the tokenizer's own default;
repeated rows and further columns of the input are kept as they are.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import WordCache, small_batches

LONG = 128
NONE = np.int64(2**62)
_SHIFT = 32
_MASK = np.int64(2**_SHIFT - 1)
_LATIN_END = "\u0250"
# The tokenizer file's split pattern, for lower-case ASCII without white space: fixed value.
_ASCII_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_loaded: dict = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class Encoder:
    """A byte-level BPE vocabulary with word ends, read from a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"]
        self.tool = Tokenizer.from_file(path)          # only its normalizer and pre-tokenizer are used
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.char_id = {c: vocab[c] for c in byte_symbols()}
        self.last_id = {c: vocab[c + end] for c in byte_symbols()}
        self.byte_of = {c: i for i, c in enumerate(byte_symbols())}
        self.inner = np.array([self.char_id[c] for c in byte_symbols()], np.int64)
        self.final = np.array([self.last_id[c] for c in byte_symbols()], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]]
        keys = np.array([a << _SHIFT | b for a, b, _ in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([m for _, _, m in pairs], np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(pairs))))

    # -- pairs ---------------------------------------------------------------------------------
    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = left << _SHIFT | right
        i = np.searchsorted(self.keys, key)
        i[i == len(self.keys)] = 0
        return np.where(self.keys[i] == key, self.ranks[i] << _SHIFT | at, NONE)

    def _encode_rows(self, sym: np.ndarray, length: np.ndarray, leaves: int) -> list[list[int]]:
        """One tree per row. sym: [rows, leaves + 1] ids, -1 beyond a row's length."""
        n, width = sym.shape
        prev = np.tile(np.arange(-1, width - 1), (n, 1))
        following = np.tile(np.arange(1, width + 1), (n, 1))
        tree = np.full((n, 2 * leaves), NONE, np.int64)
        at = np.arange(leaves)
        tree[:, leaves:] = np.where(at[None, :] < length[:, None] - 1,
                                    self._leaf(sym[:, :-1].ravel(), sym[:, 1:].ravel(),
                                               np.tile(at, n)).reshape(n, leaves), NONE)
        for k in range(leaves - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        rows = np.arange(n)

        def put(r, leaf, value):
            node = leaf + leaves
            tree[r, node] = value
            for _ in range(leaves.bit_length() - 1):
                node >>= 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        while True:
            root = tree[rows, 1]
            live = root < NONE
            if not live.all():
                rows, root = rows[live], root[live]
            if not len(rows):
                break
            i = root & _MASK
            sym[rows, i] = self.merged[root >> _SHIFT]
            j = following[rows, i]
            after = following[rows, j]
            sym[rows, j] = -1
            following[rows, i] = after
            has = after < length[rows]
            prev[rows[has], after[has]] = i[has]
            new = np.full(len(rows), NONE)
            new[has] = self._leaf(sym[rows[has], i[has]], sym[rows[has], after[has]], i[has])
            inside = j < leaves
            put(rows[inside], j[inside], NONE)
            put(rows, i, new)
            before = prev[rows, i]
            has = before >= 0
            put(rows[has], before[has], self._leaf(sym[rows[has], before[has]], sym[rows[has], i[has]], before[has]))
        alive = sym >= 0
        flat, ends = sym[alive].tolist(), np.cumsum(alive.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _encode_long(self, sym: list[int]) -> list[int]:
        """The same with one tree in a list."""
        n = len(sym)
        leaves = 1 << (n - 2).bit_length() if n > 2 else 1
        none, rank_of, merged = int(NONE), self.rank_of, self.merged

        def leaf(a, b, at):
            r = rank_of.get(a << _SHIFT | b)
            return none if r is None else r << _SHIFT | at

        tree = [none] * (2 * leaves)
        tree[leaves:leaves + n - 1] = [leaf(sym[i], sym[i + 1], i) for i in range(n - 1)]
        for k in range(leaves - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(at, value):
            node = at + leaves
            tree[node] = value
            while node > 1:
                node >>= 1
                best = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == best:
                    break
                tree[node] = best

        prev, following = list(range(-1, n - 1)), list(range(1, n + 1))
        while tree[1] < none:
            i, rank = tree[1] & int(_MASK), tree[1] >> _SHIFT
            sym[i] = int(merged[rank])
            j = following[i]
            after = following[j]
            sym[j] = -1
            following[i] = after
            if j < leaves:
                put(j, none)
            if after < n:
                prev[after] = i
                put(i, leaf(sym[i], sym[after], i))
            else:
                put(i, none)
            if prev[i] >= 0:
                put(prev[i], leaf(sym[prev[i]], sym[i], prev[i]))
        return [s for s in sym if s >= 0]

    # -- words ---------------------------------------------------------------------------------
    def _pretokens(self, words: list[str]) -> list[list[bytes]]:
        """The pre-tokens of each word, as bytes. Words hold no ASCII white space and no special token.

        ASCII words and words of Latin letters are cut here by the same rule; all others by the
        tokenizer's own normalizer and pre-tokenizer."""
        out: list = [None] * len(words)
        other = []
        for k, w in enumerate(words):
            if w.isascii() and w.isprintable():
                w = w.lower()
                out[k] = [w.encode()] if w.isalpha() else [t.encode() for t in _ASCII_PIECES.findall(w)]
            else:
                other.append(k)
        if other:
            joined = self.tool.normalizer.normalize_str("\0".join(words[k] for k in other)).split("\0")
            if len(joined) != len(other):      # a word with the separator in it
                joined = [self.tool.normalizer.normalize_str(words[k]) for k in other]
            rest = []
            for k, w in zip(other, joined):
                if w.isalpha() and max(w) < _LATIN_END:
                    out[k] = [w.encode()]
                else:
                    out[k] = []
                    rest.append((k, w))
            if rest:
                # joined by blanks, which the pre-tokenizer drops: one call for all
                ends = np.cumsum([len(w) + 1 for _, w in rest])
                cut = self.tool.pre_tokenizer.pre_tokenize_str(" ".join(w for _, w in rest))
                owner = np.searchsorted(ends, np.array([span[0] for _, span in cut], np.int64), side="right")
                for (piece, _), r in zip(cut, owner.tolist()):
                    out[rest[r][0]].append(bytes(self.byte_of[c] for c in piece))
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        cut: list[tuple[int, str]] = []            # (word, part); a part is plain or a special token
        for k, w in enumerate(words):
            if "<|" in w and self.split_special:
                cut += [(k, p) for p in self.split_special.split(w) if p]
            else:
                cut.append((k, w))
        plain = [p for _, p in cut if p not in self.special]
        split = self._pretokens(plain)
        unique = list({t for parts in split for t in parts})
        ids = dict(zip(unique, self._encode_pretokens(unique)))
        out: list[list[int]] = [[] for _ in words]
        parts = iter(split)
        for k, p in cut:
            if p in self.special:
                out[k] = [*out[k], self.special[p]]
            else:
                for t in next(parts):
                    out[k] = out[k] + ids[t] if out[k] else ids[t]
        return out

    def _encode_pretokens(self, tokens: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in tokens]
        by_size: dict[int, list[int]] = {}
        for k, t in enumerate(tokens):
            n = len(t)
            if n == 1:
                out[k] = [int(self.final[t[0]])]
            elif n - 1 > LONG:
                sym = self.inner[np.frombuffer(t, np.uint8)].tolist()
                sym[-1] = int(self.final[t[-1]])
                out[k] = self._encode_long(sym)
            elif n:
                by_size.setdefault(1 << (n - 2).bit_length() if n > 2 else 1, []).append(k)
        for leaves, members in by_size.items():
            step = max(1, (1 << 17) // leaves)
            for a in range(0, len(members), step):
                part = members[a:a + step]
                length = np.array([len(tokens[k]) for k in part])
                width = leaves + 1
                sym = np.full((len(part), width), -1, np.int64)
                raw = np.frombuffer(b"".join(tokens[k] for k in part), np.uint8)
                sym[np.arange(width)[None, :] < length[:, None]] = self.inner[raw]
                last = np.frombuffer(bytes(tokens[k][-1] for k in part), np.uint8)
                sym[np.arange(len(part)), length - 1] = self.final[last]
                for k, ids in zip(part, self._encode_rows(sym, length, leaves)):
                    out[k] = ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so the tokens are joined by blanks."""
        return " ".join(self.tokens[i] for i in ids)


def encoder(path: str) -> Encoder:
    """One per process and file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _words(text: str | None) -> list[str]:
    """Split at ASCII white space only; the tokenizer drops every white space between words."""
    if not text:
        return []
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


def digests(texts: Iterator[pd.Series], path: str) -> Iterator[pd.DataFrame]:
    enc = encoder(path)

    def both(words):
        return [(" ".join(map(str, ids)), enc.decode(ids)) for ids in enc.encode_words([w.decode() for w in words])]

    cache = _loaded.setdefault(("digests", path), WordCache(both))
    nothing = ("", "")
    for series in texts:
        split = [t.encode().split() if t else [] for t in series]
        known = cache.look_up({w for words in split for w in words})
        rows = []
        for words in split:
            found = [known[w] for w in words]
            if nothing in found:
                found = [f for f in found if f is not nothing and f[0]]
            ids = " ".join([f[0] for f in found])
            text = " ".join([f[1] for f in found])
            rows.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(),
                         hashlib.sha256(text.encode()).hexdigest()))
        yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, for every whole text."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from digests(texts, path)

    return docs.select("doc_id", run(F.col("text")).alias("r")).select("doc_id", "r.*")


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """The ids themselves: every column of ``docs`` and ``ids`` array<int>."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for s in texts:
            yield pd.Series([[i for ids in enc.encode_words(_words(t)) for i in ids] for t in s])

    return docs.withColumn("ids", run(F.col("text")))


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """Decode ``ids`` array<int> to ``decoded``; a null list stays null."""
    @F.pandas_udf("string")
    def run(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for s in lists:
            yield pd.Series([None if x is None else enc.decode(list(x)) for x in s])

    return encoded.withColumn("decoded", run(F.col("ids")))
