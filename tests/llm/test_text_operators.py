"""Operators on documents against brute force, and on empty tables, nulls, repeats and clashing columns."""

import hashlib
import math
import os
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from fixtures import DE, EN, SCHEMA, documents, edge_rows, labels, rows  # noqa: E402

from ledgerlens.llm import bpe, langid, lattice, packing, pii, quality, simhash, toxicity  # noqa: E402
from ledgerlens.llm.common import held_out  # noqa: E402

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ALL = rows() + edge_rows()


def crc(i):
    return zlib.crc32(str(i).encode()) if i is not None else None


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


def test_quality_equals_sql(spark, docs):
    con = duckdb.connect()
    con.register("documents", documents(spark, extra=False).toPandas())
    want = con.execute(quality.SQL).df()
    got = quality.judge(docs).toPandas()
    key = ["doc_id", "n_words", "n_repeat_words", "n_symbols", "fail_mask"]
    a, b = (x[list(want.columns)].sort_values(key).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(ALL) and a.equals(b.astype(a.dtypes.to_dict()))


def test_repeat_windows_by_brute_force(spark):
    texts = ["a b c d e a b c d e", "a a a a a a", "a b c d", "p a b c d e q a b c d e f r", None, "x y z w v u"]

    def brute(text):
        w = (text or "").split()
        win = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        many = Counter(win)
        return len({i + k for i, x in enumerate(win) if many[x] > 1 for k in range(5)})

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.measure(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_ablations_count_by_bits(docs):
    led = quality.apply_policy(quality.ledger(docs)).cache()
    masks = [r["fail_mask"] for r in led.collect()]
    for r in quality.ablations(led).collect():
        policy, bit = quality.POLICIES[r["version"]].mask, quality.mask_of([r["rule"]])
        assert r["rejected"] == sum(m & policy != 0 for m in masks)
        assert r["failed"] == sum(m & bit != 0 for m in masks)
        assert r["only_this"] == sum(m & policy == bit for m in masks)


def test_bpe_equals_the_tokenizer(docs):
    tok = Tokenizer.from_file(WORD_BPE)
    want = Counter()
    for i, t, *_ in ALL:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False))]
        want[(i, len(ids), *sha)] += 1
    assert Counter(map(tuple, bpe.encode_decode(docs, WORD_BPE).collect())) == want


def test_bpe_trees_agree_and_round_trip(spark):
    enc = bpe.encoder(WORD_BPE)
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeth"), n)) for n in (1, 2, 3, 5, 17, 64, 127, 129, 130, 400)] + ["a" * 300]
    tok = Tokenizer.from_file(WORD_BPE)
    for w, ids in zip(words, enc.encode_words(words)):
        assert ids == tok.encode(w, add_special_tokens=False).ids
        sym = [int(enc.inner[b]) for b in w.encode()]
        sym[-1] = int(enc.final[w.encode()[-1]])
        if len(sym) > 1:
            assert enc._encode_long(sym) == ids
    df = spark.createDataFrame([(w,) for w in words], "text string")
    for r in bpe.decode_ids(bpe.encode_ids(df, WORD_BPE), WORD_BPE).collect():
        assert r["decoded"].replace("</w>", "").replace(" ", "") == r["text"]


def test_language_mixture(spark, docs):
    got = langid.identify(docs, held_out(4, 2)).collect()
    assert len(got) == len(ALL)
    lang = {i: x for i, _, x, *_ in ALL}
    for r in got:
        text = next(t for i, t, *_ in ALL if i == r["doc_id"])
        assert r["held_out"] == (r["doc_id"] is not None and crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1
        if not text or not any(map(str.isalpha, text)):
            assert r["lang_pred"] == "und"
        elif r["doc_id"] is not None and r["doc_id"] < 60:
            assert r["lang_pred"] == lang[r["doc_id"]]
    langs, logp = langid.fit(docs, ~held_out(4, 2))
    mixed = " ".join(EN * 4 + DE * 4)
    share, chosen = langid.infer([mixed, " ".join(EN * 4)], logp)
    assert chosen[0].sum() == 2 and 0.3 < share[0].min() < 0.5 and chosen[1].sum() == 1
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.identify(empty, held_out(4, 2)).count() == 0
    kept = langid.keep_known(docs, held_out(4, 2))
    assert kept.columns == docs.columns and kept.filter("doc_id < 60").count() == 60


def test_mixture_round_raises_the_likelihood():
    rng = np.random.default_rng(0)
    like, doc = rng.normal(-5, 2, (50, 3)).astype(np.float32), np.repeat([0, 1], 25)
    share, before = np.full((2, 3), 1 / 3), np.full(2, -np.inf)
    for _ in range(8):
        share, now = langid._mixture_round(like, doc, np.array([0, 25]), share)
        assert (now >= before - 1e-3).all()
        before = now


def test_lattice_sums_over_all_segmentations():
    table = lattice.pieces(PIECES)
    logp = table.start
    place = {s: k for k, s in enumerate(table.strings)}

    def brute(s):
        if not s:
            return 1.0
        total = 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in place:
                total += math.exp(logp[place[s[:k]]]) * brute(s[k:])
            elif k == 1:
                total += math.exp(sum(logp[table.bytes_at + b] for b in s[0].encode())) * brute(s[1:])
        return total

    words = ["there", "a", "ö\u4e00x", "\U0001f642b", "thering"]
    assert np.allclose(lattice.log_marginals(words, table, logp), [math.log(brute(lattice.MARK + w)) for w in words])
    # expected uses of arcs spell each word once
    n = lattice.expected_counts(["there"], np.array([2.0]), table, logp)
    assert np.isclose(sum(n[k] * len(s) for s, k in place.items()), 2 * 6)


def test_lattice_words_sum_to_one():
    """Whole-word arcs, pieces and the end share all probability: known words, new ones and the end."""
    counts = np.array([5, 1, 1, 2, 0, 0])
    pieces = np.log([0.3, 0.1, 0.05, 0.05, 0.4, 0.1])          # a lattice over six possible words
    arcs = lattice.WordArcs(tokens=9, ends=3, kinds=4, once=2, twice=1)
    p = np.exp(arcs.log_word(pieces, counts))
    assert 0 < arcs.discount < 1 and np.isclose(p.sum() + math.exp(arcs.log_end), 1)
    assert p[0] > p[3] > p[1] > p[5]
    untrained = lattice.WordArcs(0, 0, 0, 0, 0)
    assert np.isclose(np.exp(untrained.log_word(pieces, np.zeros(6))).sum() + math.exp(untrained.log_end), 1)


def test_lattice_score_equals_brute_force(docs):
    out = lattice.score(docs, ~held_out(5, 1), PIECES, frequent=20).collect()
    train, kept = Counter(), 0
    for i, t, *_ in ALL:
        if i is None or crc(i) % 5 != 1:
            train.update([*lattice.tokens(t), "end"])
    n, v = sum(train.values()), len(train)
    want = Counter()
    for i, t, *_ in ALL:
        ts = [*lattice.tokens(t), "end"]
        base = sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts)
        want[(i, i is not None and crc(i) % 5 == 1, len(ts), sum(train[x] > 0 for x in ts), n, round(base, 6))] += 1
    assert Counter((r[0], r[1], r[2], r[3], r[4], round(r["base_score"], 6)) for r in out) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    words = {w: c for w, c in train.items() if w != "end"}
    seen = Counter(words.values())
    ends = sum(1 for i, *_ in ALL if i is None or crc(i) % 5 != 1)
    arcs = lattice.WordArcs(sum(words.values()), ends, len(words), seen[1], seen[2])
    pieces = lattice.pieces(PIECES)
    logp = pieces.start
    for _ in range(lattice.ROUNDS):
        use = lattice.PSEUDO + lattice.expected_counts([w.decode() for w in words], np.array(list(words.values()), float),
                                                       pieces, logp)
        logp = np.log(use / use.sum())
    score = Counter()
    for i, t, *_ in ALL:
        ws = lattice.tokens(t)
        each = arcs.log_word(lattice.log_marginals([w.decode() for w in ws], pieces, logp),
                             np.array([words.get(w, 0) for w in ws], float))
        score[(i, round((each.sum() + arcs.log_end) / math.log(10), 4))] += 1
    assert Counter((r["doc_id"], round(r["score"], 4)) for r in out) == score
    same = [r["score"] for r in out if r["doc_id"] in (1003, 1004)]
    assert math.isclose(*same)


def test_lattice_training_helps(docs):
    held = [r for r in lattice.score(docs, ~held_out(5, 1), PIECES, rounds=2).collect() if r["held_out"]]
    raw = {r["doc_id"]: r["score"] for r in lattice.score(docs, ~held_out(5, 1), PIECES, rounds=0).collect()}
    assert held and sum(r["score"] for r in held) > sum(raw[r["doc_id"]] for r in held)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lattice.score(empty, ~held_out(5, 1), PIECES).count() == 0
    assert packing.pack(empty, WORD_BPE).count() == 0
    assert simhash.simhash_groups(empty).count() == 0
    assert pii.detect(empty).count() == 0
    assert toxicity.score(empty, labels(spark)).count() == 0
    assert quality.judge(empty).count() == 0 and bpe.encode_decode(empty, WORD_BPE).count() == 0


def test_served_after_is_the_round_robin():
    totals = np.array([50, 7, 23, 1])
    weights = totals.astype(float)
    served = np.zeros(4, int)
    for n in range(82):
        assert (packing.served_after(n, totals, weights) == served).all()
        assert (np.abs(packing.deficits(n, totals, weights)) <= 4).all()
        if n < 81:
            s = min((k for k in range(4) if served[k] < totals[k]), key=lambda k: ((2 * served[k] + 1) / (2 * weights[k]), k))
            served[s] += 1
    assert (packing.served_after(10, np.array([3, 100]), np.array([5.0, 5.0])) == [3, 7]).all()


@pytest.mark.parametrize("target", [None, {"hot": 3.0, "s1": 1.0}])
def test_packing_places_every_token_once(docs, target):
    tok = Tokenizer.from_file(WORD_BPE)
    out = packing.pack(docs, WORD_BPE, sequence=64, window_sequences=4, target=target).toPandas()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in ALL}
    copies = Counter(i for i, *_ in ALL)
    covered = Counter()
    for r in out.itertuples():
        doc = None if r.doc_id != r.doc_id else int(r.doc_id)
        part = np.array(ids[doc][r.start:r.start + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[doc])
        covered.update((doc, k) for k in range(r.start, r.start + r.length))
    assert covered == Counter({(i, k): copies[i] for i in copies for k in range(len(ids[i]))})
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]]
        size = g["length"].sum()
        assert size == 64 or size & (size - 1) == 0
    if target is None:
        total = sum(len(v) * copies[i] for i, v in ids.items())
        hot = sum(len(ids[i]) * copies[i] for i in copies for s in [next(r[3] for r in ALL if r[0] == i)] if s == "hot")
        for _, g in out[out.window_id < total // 256].groupby("window_id"):
            assert abs(g.loc[g.source == "hot", "length"].sum() - 256 * hot / total) < 8


def test_every_source_is_a_queue_at_any_number(spark):
    # one more source than were once kept apart; the target of one of them must still hold
    data = [(i, "a", "en", f"n{i}", 1) for i in range(4096)] + [(5000 + i, "the thing over there " * 50, "en", "big", 1) for i in range(10)]
    tok = Tokenizer.from_file(WORD_BPE)
    n = Counter()
    for _, t, _, s, _ in data:
        n[s] += len(tok.encode(t, add_special_tokens=False).ids) + 1
    names = sorted(n)
    out = packing.pack(documents(spark, data), WORD_BPE, sequence=64, window_sequences=4, target={"big": 4096.0, "n0": 1.0}).toPandas()
    assert out["length"].sum() == n.total()
    totals, weights = np.array([n[s] for s in names]), np.array([4096.0 if s == "big" else 1.0 for s in names])
    for w in (0, 3, 10, 20):
        want = packing.served_after(256 * (w + 1), totals, weights)
        got = out[out.window_id <= w].groupby("source")["length"].sum()
        assert [got.get(s, 0) for s in names] == want.tolist()
    assert out.loc[out.window_id == 0, "length"].sum() == out.loc[(out.window_id == 0) & (out.source == "big"), "length"].sum() == 256


def brute_fingerprint(text):
    w = text.encode().lower().split() if text else []
    if not w:
        return 0
    sh = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items, bits=3):
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(items):
        for j in range(i):
            if (a ^ items[j][1]).bit_count() <= bits:
                root[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(items):
        out.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in out.items()}
    return [least[find(i)] for i in range(len(items))]


def test_simhash_groups_equal_brute_force(spark, docs):
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(docs).collect())
    items = [(i, brute_fingerprint(t)) for i, t, *_ in ALL]
    comp = brute_components(items)
    assert got == Counter((i, f"{f:016x}", c) for (i, f), c in zip(items, comp))


@pytest.mark.parametrize("seed", [0, 1])
def test_grid_join_loses_no_link(spark, seed):
    rng = np.random.default_rng(seed)
    prints = []
    for _ in range(30):
        f = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        for _ in range(12):
            prints.append(f)
            for b in rng.choice(64, rng.integers(0, 4), replace=False):
                f ^= 1 << int(b)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    got = {(int(np.int64(r["a"]).view(np.uint64)), int(np.int64(r["b"]).view(np.uint64))) for r in simhash.links(df).collect()}
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in got)
    place = {p: k for k, p in enumerate(prints)}
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        root[find(place[a])] = find(place[b])
    want = brute_components([(k, p) for k, p in enumerate(prints)])
    mine = [min(j for j in range(len(prints)) if find(j) == find(k)) for k in range(len(prints))]
    assert mine == want


def test_forest_of_a_large_cell():
    base = 0x0123456789ABCDEF
    fps = np.array([base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)], np.uint64)
    edges = simhash._cell_links(np.zeros(len(fps), np.int64), np.zeros(len(fps), bool), fps, 3)
    assert len(edges) == len(fps) - 1 and (np.bitwise_count(edges[:, 0] ^ edges[:, 1]) <= 3).all()


def test_one_document_of_each_group(spark, docs):
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    items = [(i, brute_fingerprint(t)) for i, t, *_ in ALL]
    assert set(ids.values()) == {1} and set(ids) == set(brute_components(items))


def test_pii_base_and_additions(spark, docs):
    out = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    for i, t, *_ in ALL:
        spans = pii.base_spans(t or "")[0]
        assert out[i]["base_sha256"] == hashlib.sha256(pii._join(spans).encode()).hexdigest()
        assert {*pii._join(spans).split(",")} - {""} <= {*out[i]["spans"].split(",")}
        if i is not None and i < 60 and i % 10 == 7:
            assert (out[i]["n_email"], out[i]["n_ip"], out[i]["n_card"], out[i]["n_phone"]) == (1, 1, 1, 1)
        if i is not None and i < 60 and i % 10 != 7:
            assert out[i]["spans"] == ""


def test_zero_padded_ip_parts():
    found = "0" * 5000 + "1.255.000.7"
    assert pii.base_spans(f"at {found} now")[0] == [("ip", 3, 3 + len(found))]
    assert not pii.passes("ip", "1.2.3." + "0" * 400 + "256") and not pii.passes("ip", "1.2.3." + "9" * 500)


def test_field_learns_held_out_windows(spark):
    data = [(i, f"call me at +1 ({100 + i}) 555-{2000 + 7 * i} or mail u{i}@mail{i % 9}.example.org soon please {i} times", "en", "s", 1)
            for i in range(120)]
    table = pii.labelled_windows(spark.createDataFrame(data, SCHEMA))
    assert len(table) >= 60
    seqs = [pii._features(w, [m.span() for m in pii._WORD.finditer(w)]) for w, _ in table]
    cut = len(table) // 2
    field = pii.train(seqs[:cut], [t for _, t in table[:cut]])
    got = field.viterbi(seqs[cut:])
    right = sum(a == b for g, (_, t) in zip(got, table[cut:]) for a, b in zip(g, t))
    assert right >= 0.97 * sum(len(t) for _, t in table[cut:])


def test_viterbi_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(5)
    field = pii.Field(rng.normal(size=(pii.FEATURES, len(pii.TAGS))), rng.normal(size=(len(pii.TAGS),) * 2))
    seqs = [[list(rng.integers(0, pii.FEATURES, 3)) for _ in range(n)] for n in (1, 2, 3)]
    for seq, path in zip(seqs, field.viterbi(seqs)):
        pot = np.array([field.emit[f].sum(0) for f in seq])
        best = max(product(range(len(pii.TAGS)), repeat=len(seq)),
                   key=lambda p: sum(pot[k, t] for k, t in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:])))
        assert path == list(best)


def test_redaction_keeps_clean_texts(docs):
    before = {(r["doc_id"], r["text"]) for r in docs.collect()}
    out = pii.redact(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        if r["doc_id"] is not None and r["doc_id"] < 60 and r["doc_id"] % 10 == 7:
            assert "[email]" in r["text"] and "bob.42" not in r["text"] and "4041894974608795" not in r["text"]
            assert r["n_chars"] == len(r["text"])
        else:
            assert (r["doc_id"], r["text"]) in before


def test_grammar_reads_clauses():
    lex = toxicity.Lexicon({"blorg": 3.0, "zzbad*": 3.0})

    def one(t):
        return toxicity.evidence(t, lex)[0]

    assert one("what a blorg") > 0 and one("plain words only") == 0 and one("zzbadium") > 0
    assert one("you blorg") > one("what a blorg") > one("he said what a blorg") and one("not a blorg") < one("a blorg")
    assert one("he said nothing. a blorg") == one("a blorg")           # a clause's end resets the state
    assert one("i will kill you") < one("you, they will kill you") or one("you will kill") > one("will kill")


def test_toxicity_finds_labelled_kind(spark, docs):
    out = toxicity.score(docs, labels(spark)).collect()
    assert len(out) == len(ALL)
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] is not None and r["doc_id"] < 60:
            assert r["predicted"] == int(r["doc_id"] % 10 == 4)
    kept = toxicity.keep_clean(docs, labels(spark))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect() if (r["doc_id"] or 99) < 60} == {
        i for i in range(1, 60) if i % 10 != 4}


def test_insult_words_of_a_new_language_are_learnt(spark):
    rng = np.random.default_rng(2)
    data, lab = [], []
    for i in range(300):
        w = list(rng.choice(DE, 30))
        if i % 5 == 0:
            w.insert(int(rng.integers(0, 30)), "vequ" + str(rng.choice(["ta", "ille", "ance", "eur"])))
        if i % 50 == 1:
            w += ["copied", "passage", "uniqueword"]          # often, but in one surrounding
        data.append((i, " ".join(w), "xx", "s", 1))
        lab.append((i, 1, int(i % 5 == 0 or i % 50 == 1)))
    df, lb = spark.createDataFrame(data, SCHEMA), spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
    learnt, by_bin = toxicity.fit(df, lb, held_out(4, 2))
    assert "vequ*" in learnt and "uniqueword" not in learnt
    assert by_bin == sorted(by_bin)
    # no labels at all: nothing learnt, scores still defined
    none = lb.filter("doc_id < 0")
    assert toxicity.score(df, none).filter(F.col("score").isNull()).count() == 0
