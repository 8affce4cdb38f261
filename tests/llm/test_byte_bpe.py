"""The rank queue against the tiktoken library, its own queue against a plain search, and odd inputs."""

import base64
import hashlib
import os
import random
import sys

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from fixtures import SCHEMA, documents, edge_rows, rows  # noqa: E402

from ledgerlens.llm import bytebpe  # noqa: E402
from ledgerlens.llm.common import WordCache  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ENC = bytebpe.encoder(PATH, public_tokenizers.PATTERN)
TOOL = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ENC.ranks, special_tokens={})


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_query_equals_library(spark):
    got = bytebpe.encode_decode(documents(spark), PATH, public_tokenizers.PATTERN).collect()
    want = []
    for doc_id, text, *_ in rows() + edge_rows():
        ids = TOOL.encode_ordinary(text or "")
        want.append((doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha(TOOL.decode_bytes(ids))))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*" \t\n\x0b\x1c\x85　'sdab1é中!", "the", " in", "  "]), max_size=40).map("".join))
def test_text_equals_library(text):
    ids = ENC.encode(text)
    assert ids == TOOL.encode_ordinary(text)
    assert ENC.decode(ids) == text.encode()


def test_long_pretokens(spark):
    rnd = random.Random(5)
    texts = ["a" * 60_000, "".join(rnd.choices("abcdefghij", k=60_000)), "".join(rnd.choices("中文字語", k=20_000)),
             "ab" * 30_000, "." * 20_000, " " * 20_000]
    for t in texts:
        assert ENC.encode(t) == TOOL.encode_ordinary(t)


def test_merges_that_make_lower_ranks():
    """Ranks in any order: a merge may make a pair of a lower rank, then the rest of the bucket waits."""
    rnd = random.Random(7)
    for _ in range(200):
        tokens = {bytes([b]) for b in b"abc"}
        while len(tokens) < 20:
            tokens.add(rnd.choice(sorted(tokens)) + rnd.choice(sorted(tokens)))
        order = sorted(tokens)
        rnd.shuffle(order)
        enc = bytebpe.Encoder.__new__(bytebpe.Encoder)
        enc._set_ranks({t: i for i, t in enumerate(order)})
        pieces = [bytes(rnd.choices(b"abc", k=rnd.randrange(1, 30))) for _ in range(20)]
        together = enc.encode_pieces(pieces)
        assert not enc.queue.top and not enc.queue.buckets
        for piece, ids in zip(pieces, together):
            parts = [piece] if piece in enc.ranks else [bytes([b]) for b in piece]
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: enc.ranks.get(parts[i] + parts[i + 1], 99))
                if parts[best] + parts[best + 1] not in enc.ranks:
                    break
                parts[best:best + 2] = [parts[best] + parts[best + 1]]
            assert ids == [enc.ranks[p] for p in parts]
            assert enc.encode_pieces([piece]) == [ids] and (piece in enc.ranks or enc._merged([piece]) == [ids])
            assert not enc.queue.top and not enc.queue.buckets


def test_rank_file_and_round_trip(spark):
    with open(PATH, "rb") as f:
        first = f.readline().split()
    assert ENC.ranks[base64.b64decode(first[0])] == int(first[1])
    df = bytebpe.encode_ids(documents(spark, extra=False), PATH, public_tokenizers.PATTERN)
    back = bytebpe.decode_ids(df, PATH, public_tokenizers.PATTERN).collect()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back)
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytebpe.decode_ids(none, PATH, public_tokenizers.PATTERN).first()["decoded"] is None


def test_empty_table(spark):
    out = bytebpe.encode_decode(spark.createDataFrame([], SCHEMA), PATH, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == 0


def test_word_cache_is_bounded_by_bytes():
    cache = WordCache(lambda ws: [w * 2 for w in ws], limit=1000, limit_bytes=50_000)
    for k in range(200):
        words = {f"w{k}-{i}" for i in range(20)} | {"same", str(k) * 300}
        found = cache.look_up(words)
        assert all(found[w] == w * 2 for w in words)
    assert len(cache.young) + len(cache.old) < 500
    assert sum(len(w) > cache.LONG_WORD for w in [*cache.young, *cache.old]) <= 2
