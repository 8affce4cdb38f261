"""Personal data: pattern matches, and a linear-chain conditional random field over word shapes.

The base finds e-mail addresses, IP addresses, payment cards and phone numbers by pattern and checks
(a match that fails its check is dropped). The random field labels the words around digits, @ and +
with these kinds from features of each word's shape, ends and length and of its neighbours' shapes,
and is decoded by Viterbi in numpy batches. What it finds is added where no base match lies; inside
a match that the base dropped (a card run together with the next number), only if it passes the check.

It is trained in numpy on a small table of word windows that the base labels, from about SAMPLE
documents (those with the smallest hash) and MAX_WINDOWS windows at most: the documented bound of this
classifier. Every text is then searched whole. Runs of plain words (no digit, @ or +) are never
personal data of these kinds, so a window reaches REACH words to either side of the others.

Edge cases: null and empty texts have no spans; without windows to learn from nothing is added;
repeated rows are searched each; ``redact`` keeps further columns; offsets count code points.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import small_batches

# Patterns, checks and their order: fixed values of the query contract.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
SAMPLE = 4000
MAX_WINDOWS = 6000
REACH = 2
FEATURES = 1 << 12         # hashed
ROUNDS = 60
VITERBI_WORDS = 1 << 15    # padded words decoded together
TAGS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
_MARKED = re.compile(r"[0-9@+]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in found.split(".")))
    digits = "".join(c for c in found if "0" <= c <= "9")
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """(spans by kind, then start; places of matches that failed their check)."""
    spans, dropped = [], []
    if not _MARKED.search(text):
        return spans, dropped
    for kind in KINDS:
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
            continue
        for m in PATTERNS[kind].finditer(text):
            if passes(kind, m[0]):
                spans.append((kind, m.start(), m.end()))
            elif kind != "card" or m.end() - m.start() > 8:
                dropped.append((m.start(), m.end()))
    return spans, dropped


# -- windows and features ------------------------------------------------------------------------
def shape(word: str) -> str:
    """Word shape: runs of digits, of upper and of lower letters, other characters as they are."""
    s = re.sub(r"[0-9]+", lambda m: "d" if len(m[0]) < 5 else "D", word[:64])
    return re.sub(r"[^\W\d_]+", lambda m: m[0] if m[0] in "dD" else "X" if m[0].isupper() else "x", s)[:16]


def _own(word: str) -> list[int]:
    n = len(word)
    raw = [f"s={shape(word)}", f"p={word[:1]}", f"e={word[-1:]}", f"n={min(n, 20) // 2}",
           f"g={min(20, len(_DIGIT.findall(word[:64])))}", f"a={'@' in word}", f"t={min(5, word.count('.'))}"]
    return [zlib.crc32(f.encode()) % FEATURES for f in raw]


def _beside(word: str | None, side: str) -> int:
    return zlib.crc32(f"{side}={'' if word is None else shape(word)}".encode()) % FEATURES


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Runs of word places around the words with a digit, @ or +."""
    out: list[list[tuple[int, int]]] = []
    at = 0
    while m := _MARKED.search(text, at):
        lo, hi = m.start(), m.end()
        while lo and text[lo - 1] not in " \t\n\x0b\f\r":
            lo -= 1
        w = _WORD.match(text, lo)
        place = (lo, w.end())
        before = []
        left = lo
        for _ in range(REACH):                  # words to the left, not over the last window's
            while left and text[left - 1] in " \t\n\x0b\f\r":
                left -= 1
            end = left
            while left and text[left - 1] not in " \t\n\x0b\f\r":
                left -= 1
            if end > left and (not out or left >= out[-1][-1][1]):
                before.append((left, end))
        if out and not before and out[-1][-1][1] <= lo or out and before and before[-1][0] <= out[-1][-1][1] + 1:
            run = out[-1]
        else:
            run = []
            out.append(run)
        run += [p for p in reversed(before) if not run or p[0] >= run[-1][1]]
        run.append(place)
        at = hi = place[1]
        for _ in range(REACH):
            w = _WORD.search(text, hi, hi + 64)
            if not w or w.end() == hi + 64 or _MARKED.search(w[0]):
                break
            run.append((w.start(), w.end()))
            hi = w.end()
        at = max(at, hi)
    return out


def _features(text: str, run: list[tuple[int, int]]) -> list[list[int]]:
    words = [text[a:b] for a, b in run]
    sides = [None, *words, None]
    return [[*_own(w), _beside(sides[k], "l"), _beside(sides[k + 2], "r")] for k, w in enumerate(words)]


def tags_of(run: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[int]:
    """The tag of each word: that of the span it overlaps."""
    out = []
    for a, b in run:
        hit = next(((k, s) for k, s, e in spans if s < b and a < e), None)
        out.append(0 if hit is None else TAGS.index(f"{'B' if hit[1] >= a else 'I'}-{hit[0]}"))
    return out


class Field:
    """Weights of a linear-chain conditional random field: [feature, tag] and [tag, tag]."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def potentials(self, batch: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """[sequence, place, tag] padded, and the lengths."""
        size = np.array([len(s) for s in batch])
        f = np.array([w for s in batch for w in s])
        out = np.zeros((len(batch), size.max(), len(TAGS)))
        total = self.emit[f[:, 0]]
        for j in range(1, f.shape[1]):
            total += self.emit[f[:, j]]
        out[np.arange(size.max())[None, :] < size[:, None]] = total
        return out, size

    def viterbi(self, batch: list[list[list[int]]]) -> list[list[int]]:
        """The best tags of every sequence; sequences of like length go forward together, at most
        VITERBI_WORDS padded words at once (one sequence at least)."""
        order = sorted(range(len(batch)), key=lambda k: len(batch[k]))
        out: list[list[int]] = [[]] * len(batch)
        parts: list[list[int]] = []
        for k in order:
            if not parts or (len(parts[-1]) + 1) * len(batch[k]) > VITERBI_WORDS:
                parts.append([])
            parts[-1].append(k)
        for part in parts:
            pot, size = self.potentials([batch[k] for k in part])
            n, longest, tags = pot.shape
            best, back = pot[:, 0], np.zeros((n, longest, tags), np.int8)
            for t in range(1, longest):
                step = best[:, :, None] + self.move[None]
                back[:, t] = step.argmax(1)
                new = np.take_along_axis(step, back[:, t].astype(np.int64)[:, None], 1)[:, 0] + pot[:, t]
                best = np.where((t < size)[:, None], new, best)
            for r, k in enumerate(part):
                tag, path = int(best[r].argmax()), []
                for t in range(size[r] - 1, -1, -1):
                    path.append(tag)
                    tag = int(back[r, t, tag])
                out[k] = path[::-1]
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(sequences: list[list[list[int]]], tags: list[list[int]], rounds: int = ROUNDS, rate: float = 0.15,
          penalty: float = 1e-4) -> Field:
    """Maximum likelihood by gradient ascent (Adam), with the forward-backward recursions over padded batches."""
    k = len(TAGS)
    theta = [np.zeros((FEATURES, k)), np.zeros((k, k))]
    field = Field(*theta)
    size = np.array([len(s) for s in sequences])
    longest, n = size.max(), len(sequences)
    inside = np.arange(longest)[None, :] < size[:, None]
    f = np.array([w for s in sequences for w in s])
    gold = np.zeros((n, longest), int)
    gold[inside] = [t for s in tags for t in s]
    pairs = inside[:, 1:]
    seen = [np.zeros((FEATURES, k)), np.zeros((k, k))]
    for j in range(f.shape[1]):
        np.add.at(seen[0], (f[:, j], gold[inside]), 1)
    np.add.at(seen[1], (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, rounds + 1):
        pot = np.zeros((n, longest, k))
        pot[inside] = theta[0][f].sum(1)
        alpha, beta = [pot[:, 0]], [np.zeros((n, k))]
        for t in range(1, longest):
            a = _log_sum(alpha[-1][:, :, None] + theta[1][None], 1) + pot[:, t]
            alpha.append(np.where(inside[:, t, None], a, alpha[-1]))
        for t in range(longest - 2, -1, -1):
            b = _log_sum(theta[1][None] + (pot[:, t + 1] + beta[0])[:, None, :], 2)
            beta.insert(0, np.where(inside[:, t + 1, None], b, 0.0))
        z = _log_sum(alpha[-1], 1)
        expected = [np.zeros((FEATURES, k)), np.zeros((k, k))]
        single = np.exp(np.stack(alpha, 1) + np.stack(beta, 1) - z[:, None, None])[inside]
        for j in range(f.shape[1]):
            np.add.at(expected[0], f[:, j], single)
        for t in range(1, longest):
            two = alpha[t - 1][:, :, None] + theta[1][None] + (pot[:, t] + beta[t])[:, None, :] - z[:, None, None]
            expected[1] += np.exp(two[inside[:, t]]).sum(0)
        for i in range(2):
            g = (seen[i] - expected[i]) / n - penalty * theta[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            theta[i] = theta[i] + rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        field = Field(*theta)
    return field


def labelled_windows(docs: DataFrame, sample: int = SAMPLE, limit: int = MAX_WINDOWS) -> list[tuple[str, list[int]]]:
    """The small labelled table: words (joined by blanks) and tags of windows from about ``sample`` documents."""
    small_batches(docs.sparkSession)
    n = docs.count()
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, sample / max(1, n))) + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                spans, _ = base_spans(text)
                for run in windows(text):
                    rows.append((" ".join(text[x:y] for x, y in run), tags_of(run, spans)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                              pa.array([r[1] for r in rows], pa.list_(pa.int32()))], names=["words", "tags"])

    table = docs.filter(F.col("text").isNotNull() & part).select("text").mapInArrow(cut, "words string, tags array<int>")
    table = table.filter(F.length("words") < 1000).orderBy(F.xxhash64("words"), "words").limit(limit)
    return [(r["words"], list(r["tags"])) for r in table.collect()]


def fit(docs: DataFrame) -> Field | None:
    table = labelled_windows(docs.select("doc_id", "text"))
    if not any(any(t) for _, t in table):
        return None
    sequences = []
    for words, _ in table:
        places = [m.span() for m in _WORD.finditer(words)]
        sequences.append(_features(words, places))
    return train(sequences, [t for _, t in table])


def added_spans(texts: list[str], bases: list, field: Field) -> list[list[tuple[str, int, int]]]:
    """What the field finds beside the base's matches."""
    runs = [(k, run) for k, t in enumerate(texts) for run in windows(t)]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    # a window whose marked words all lie in matches has nothing to add
    todo = []
    for k, run in runs:
        taken = [(s, e) for _, s, e in bases[k][0]]
        if any(_MARKED.search(texts[k][a:b]) and not any(s < b and a < e for s, e in taken) for a, b in run):
            todo.append((k, run, taken))
    if not todo:
        return out
    paths = field.viterbi([_features(texts[k], run) for k, run, _ in todo])
    for (k, run, taken), path in zip(todo, paths):
        j = 0
        while j < len(path):
            if not path[j]:
                j += 1
                continue
            kind = TAGS[path[j]][2:]
            e = j + 1
            while e < len(path) and TAGS[path[e]] == f"I-{kind}":
                e += 1
            a, b = run[j][0], run[e - 1][1]
            while b > a and texts[k][b - 1] in ".,;:!?\"')":
                b -= 1
            while a < b and texts[k][a] in "\"'(":
                a += 1
            again = any(s < b and a < x for s, x in bases[k][1])      # in what the base dropped: only if it passes now
            fits = not again or PATTERNS[kind].fullmatch(texts[k], a, b) and passes(kind, texts[k][a:b])
            if b > a and fits and _MARKED.search(texts[k], a, b) and not any(s < b and a < x for s, x in taken):
                out[k].append((kind, a, b))
                taken.append((a, b))
            j = e
    return out


def find(texts: list[str | None], field: Field | None) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, each by kind, then start."""
    plain = [t or "" for t in texts]
    bases = [base_spans(t) for t in plain]
    more = added_spans(plain, bases, field) if field else [[] for _ in plain]
    order = {k: i for i, k in enumerate(KINDS)}
    return [(b, sorted(b + m, key=lambda s: (order[s[0]], s[1])) if m else b) for (b, _), m in zip(bases, more)]


def _join(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def detect(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, counts by kind and digest of the base spans, and all spans, of every whole text."""
    field = field or fit(docs)
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            rows = []
            for base, spans in find(list(s), field):
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", run(F.col("text")).alias("r")).select("doc_id", "r.*")


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; n_chars, where there is one, follows the text."""
    field = field or fit(docs)
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            out = []
            for text, (_, spans) in zip(s, find(list(s), field)):
                if spans:
                    # overlapping spans of several kinds go as one, under the first one's name
                    parts, at = [], 0
                    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
                        if a >= at:
                            parts += [text[at:a], f"[{kind}]"]
                        at = max(at, b)
                    text = "".join(parts) + text[at:]
                out.append(text)
            yield pd.Series(out, dtype=object)

    out = docs.withColumn("text", run(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
