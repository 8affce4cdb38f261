import numpy as np

from ledgerlens.llm import langid, pii


def test_word_likelihoods_in_slices(monkeypatch):
    rng = np.random.default_rng(3)
    logp = rng.normal(-8, 2, (langid.BUCKETS, 100)).astype(np.float32)
    grams = rng.integers(0, langid.BUCKETS, 5000)
    start = np.array([0, 3, 4, 90, 2500, 4999])
    whole = np.add.reduceat(logp[grams], start, axis=0)
    for cells in (1, 700, 100_000, 1 << 24):
        monkeypatch.setattr(langid, "CELLS", cells)
        assert np.allclose(langid._word_likelihoods(grams, start, logp), whole, rtol=1e-4)


def test_texts_are_taken_together_within_the_bound(monkeypatch):
    monkeypatch.setattr(langid, "CELLS", 1000)
    texts = ["x" * n for n in (5, 400, 700, 3000, 1, 1)]
    runs = list(langid._together(texts, 1))
    assert [i for a, b in runs for i in range(a, b)] == list(range(6)) and (3, 4) in runs
    assert list(langid._together([], 4)) == []


def test_languages_alone_and_together_agree(monkeypatch):
    rng = np.random.default_rng(4)
    logp = np.log(rng.dirichlet(np.full(langid.BUCKETS, 0.05), 40).T + 1e-9).astype(np.float32)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n)) for n in (1, 30, 200)]
    share, chosen = langid.infer(texts, logp)
    monkeypatch.setattr(langid, "CELLS", 4000)
    for t, s, c in zip(texts, share, chosen):
        one, kept = langid.infer([t], logp)
        assert np.allclose(one[0], s, atol=1e-3) and (kept[0] == c).all()


def test_best_path_equals_enumeration_with_unequal_lengths():
    import itertools
    rng = np.random.default_rng(5)
    k = len(pii.TAGS)
    field = pii.Field(rng.normal(0, 1, (pii.FEATURES, k)), rng.normal(0, 1, (k, k)))
    some = [[rng.integers(0, pii.FEATURES, 4).tolist() for _ in range(n)] for n in (1, 3, 2, 4)]

    def value(seq, tags):
        return (sum(field.emit[f, t] for w, t in zip(seq, tags) for f in w)
                + sum(field.move[a, b] for a, b in zip(tags, tags[1:])))

    for seq, got in zip(some, field.viterbi(some)):
        best = max(itertools.product(range(k), repeat=len(seq)), key=lambda tags: value(seq, tags))
        assert np.isclose(value(seq, got), value(seq, best))


def test_a_long_sequence_beside_many_short_ones(monkeypatch):
    sizes = []
    plain = pii.Field.potentials

    def seen(self, batch):
        out = plain(self, batch)
        sizes.append(out[0].shape[0] * out[0].shape[1])
        return out

    monkeypatch.setattr(pii.Field, "potentials", seen)
    k = len(pii.TAGS)
    field = pii.Field(np.zeros((pii.FEATURES, k)), np.zeros((k, k)))
    some = [[[1, 2]] * 3 for _ in range(511)] + [[[1, 2]] * 16_000]
    assert [len(p) for p in field.viterbi(some)] == [len(s) for s in some]
    assert max(sizes) <= max(pii.VITERBI_WORDS, 16_000)
