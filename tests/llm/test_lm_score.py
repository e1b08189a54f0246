"""The trie against plain searching, and scores against a model of dictionaries."""

import math
import mmap
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyspark.llm import lm_score
from tallyspark.llm.common import table
from tallyspark.llm.elias_fano import ABSENT, EliasFano, Trie, restored


@pytest.mark.parametrize("n,top", [(1, 1), (1, 2**62), (5, 5), (1000, 2**40), (1000, 300), (64, 64), (20_000, 2**45)])
def test_monotone_sequences(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n))
    made = EliasFano.of(values)
    seq, _ = EliasFano.read(np.concatenate(made.words()), 0)
    assert (seq[np.arange(n)] == values).all()
    asked = np.r_[values, values + 1, rng.integers(0, top, n), 0, 2**62]
    at, there = seq.successor(asked)
    assert (at == np.searchsorted(values, asked)).all() and (there == np.isin(asked, values)).all()
    bits = 64 * sum(len(w) for w in made.words())
    assert n < 1000 or bits < n * (3.6 + max(0, math.log2(top / n)))


def test_trie_in_a_mapped_file(tmp_path):
    rng = random.Random(1)
    grams = Counter((rng.randint(0, 40) << 50, rng.randint(0, 99)) for _ in range(2000))
    c, w = (np.array(x) for x in zip(*sorted(grams)))
    count = np.array([grams[g] for g in sorted(grams)])
    (tmp_path / "t").write_bytes(Trie.of(c, w, count, 0.5).bytes())
    with open(tmp_path / "t", "rb") as f:
        trie = Trie.read(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    total = Counter()
    for (a, _), k in grams.items():
        total[a] += k
    keys = np.array(sorted({*total, 5, 2**60}))
    place, got, kinds = trie.context(keys)
    assert [int(x) for x in got] == [total[int(k)] for k in keys]
    assert [int(x) for x in kinds] == [sum(a == int(k) for a, _ in grams) for k in keys]
    for k, at in zip(keys, place):
        codes = trie.code(np.full(120, at), np.arange(120))
        for x, code in enumerate(codes):
            seen = grams[int(k), x]
            assert (code == ABSENT) == (seen == 0)
            assert not seen or abs(restored(np.array([code]))[0] / ((seen - 0.5) / total[int(k)]) - 1) < 4e-4


def plain(docs):
    """[(doc_id, held_out, n_tokens, n_known, N, base, score)] of [(doc_id, text)]."""
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    words = lambda t: [*(t or "").translate({k: k + 32 for k in range(65, 91)}).encode().split(), None]
    c, two, after = Counter(), Counter(), defaultdict(set)
    for i, t in docs:
        if not held(i):
            ws = words(t)
            c.update(ws)
            for a, b in zip([None, *ws], ws):
                two[a, b] += 1
                after[a].add(b)
    n, v = sum(c.values()), len(c)
    one = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))

    def p(a, b):
        return max(two[a, b] - 0.75, 0) / c[a] + 0.75 * len(after[a]) / c[a] * one(b) if c[a] else one(b)

    out = []
    for i, t in docs:
        ws = words(t)
        out.append((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10(one(w)) for w in ws), sum(math.log10(p(a, b)) for a, b in zip([None, *ws], ws))))
    return out


def agree(got, want):
    order = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    got, want = sorted((tuple(r) for r in got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        # codes are steps of 1/4096 of a decimal logarithm
        assert g[6] == pytest.approx(w[6], abs=1e-6 + w[2] / 8000)


def test_like_dictionaries(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents")
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 50_000)
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 10_000)
    agree(lm_score.score_texts(docs).collect(), plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))


def test_edges(spark, edges, empty):
    rows = edges.select("doc_id", "text").collect()
    agree(lm_score.score_texts(edges).collect(), plain([tuple(r) for r in rows]))
    assert lm_score.score_texts(empty).count() == 0
    (only,) = lm_score.score_texts(edges.filter("doc_id is null and text is null")).collect()
    assert (only.n_tokens, only.n_known, only.train_tokens, only.base_score, only.score) == (1, 0, 0, 0.0, 0.0)


def test_probabilities_sum_to_one():
    docs = [(k, t) for k, t in enumerate(["a b a c", "b b a", "c a b a b"], 1)]
    c = Counter(w for _, t in docs for w in [*t.split(), None])
    n, v = sum(c.values()), len(c)
    assert sum((c[w] + 0.1) / (n + 0.1 * (v + 1)) for w in [*c, "unseen"]) == pytest.approx(1)
