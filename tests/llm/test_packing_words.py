"""The packing tokenizer's shortcut for plain words gives the tool's own ids."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgerlens.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_equal_the_tool():
    tool = Tokenizer.from_file(PATH)
    words = packing._Words(tool)
    assert words.simple is not None and words.simple("Straße.,") and words.simple("don't") is None
    letters = [chr(c) for c in range(0x250)]
    given = [a + b for a in letters for b in ("", ".", "x!", "É?;", "'s", "7")]
    given += ["Hello,", "WORLD", "it's", "<|endoftext|>", "...", "a" * 700, "é" * 300 + ":", "中文,", "éa", "x y", "\0a", "\0"]
    given = [w for w in given if w.strip()]
    got = words.encode([w.encode() for w in given])
    for w, ids in zip(given, got):
        assert np.frombuffer(ids, words.kind).tolist() == tool.encode(w, add_special_tokens=False).ids, w


def test_without_the_shortcut():
    tool = Tokenizer.from_file(PATH)
    words = packing._Words(tool)
    words.simple = None
    given = [b"Hello,", b"world", "Straße".encode()]
    assert words.encode(given) == packing._Words(tool).encode(given)


def test_served_tokens_take_few_steps(monkeypatch):
    """The state of a window's end, made in every task: whole queues, used-up ones and ties, played token by token."""
    rng = np.random.default_rng(3)
    for weights in (None, np.array([5.0, 1.0, 1.0, 0.25]), np.ones(4)):
        totals = rng.integers(1, 60, 4)
        w = totals.astype(float) if weights is None else weights
        order = sorted(((2 * k + 1) / (2 * float(w[s])), s) for s in range(4) for k in range(int(totals[s])))
        for n in range(int(totals.sum()) + 2):
            want = np.bincount([s for _, s in order[:n]], minlength=4)
            assert packing.served_after(n, totals, w).tolist() == want.tolist()
    calls = []
    floor = np.floor
    monkeypatch.setattr(np, "floor", lambda v: calls.append(1) or floor(v))
    totals = np.array([10**9, 3 * 10**9, 7 * 10**8, 5])
    assert packing.served_after(10**9 + 7, totals, totals.astype(float)).sum() == 10**9 + 7 and len(calls) < 10
