import re
import zlib
from collections import Counter
from math import log10

import numpy as np

from tidepanel.llm import ngrams
from tidepanel.llm.queries import op6_backoff_automaton


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


class Slow:
    """The same model by definition: counts of all n-grams and the interpolation formula."""

    def __init__(self, texts):
        seqs = [words(t) for t in texts]
        self.c = Counter(w for s in seqs for w in s)
        self.n = sum(self.c.values())
        n1, n2 = (sum(v == k for v in self.c.values()) for k in (1, 2))
        self.d = n1 / (n1 + 2 * n2) if n1 and n2 else ngrams.DISCOUNT
        self.two = Counter(p for s in seqs for p in zip([None, *s], s))
        self.three = Counter(t for s in seqs for t in zip([None, *s], s, s[1:]))

    def p1(self, w):
        return (self.c[w] - self.d if w in self.c else self.d * len(self.c)) / self.n

    def p2(self, v, w):
        return (self.two[v, w] + ngrams.PRIORS[1] * self.p1(w)) / (self.c[v] + ngrams.PRIORS[1])

    def score(self, text):
        total, u, v = 0.0, None, None
        for i, w in enumerate(words(text)):
            p = self.p2(v, w)
            if i:
                p = (self.three[u, v, w] + ngrams.PRIORS[2] * p) / (self.two[u, v] + ngrams.PRIORS[2])
            total += log10(p)
            u, v = v, w
        return total


def corpus(n=120, seed=5):
    r = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(40)] + ["The", "É", "x,"]
    weights = 1 / np.arange(1, len(vocab) + 1)
    texts = [" ".join(r.choice(vocab, r.integers(0, 60), p=weights / weights.sum())) + (" the end of\tline" if i % 3 else f"\nrare{i} odd") for i in range(n)]
    return texts + [None, "", " ", "THE the tHe", texts[0] * 60]


def test_scores_match_the_definition(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "SEGMENT", 50)
    texts = corpus()
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(7, "the end of it", 2), (None, "w1 w2", 3)]
    held = {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2}
    train = [t for i, t, _ in rows if i not in held]
    slow = Slow(train)
    c = slow.c
    want = []
    for i, t, _ in rows:
        s = words(t)
        want.append((i if i is not None else -1, len(s), sum(w in c for w in s), round(sum(log10((c[w] + 1) / (slow.n + len(c) + 1)) for w in s), 6), round(slow.score(t), 6)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    from pyspark.sql import functions as F

    for sizes in ({}, {"part": 2000, "span": 200}):  # one part and range, and many
        out, model = ngrams.score_all(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, **sizes)
        assert model.total == slow.n and model.distinct == len(c)
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in out.collect())
        for g, w in zip(got, sorted(want), strict=True):
            assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-5 and abs(g[4] - w[4]) < 1e-5


def test_probabilities_sum_to_one():
    slow = Slow(corpus())
    for v in (None, "w1", "odd"):
        context = slow.c[v]
        if v is None or context:
            assert abs(sum(slow.p2(v, w) for w in [*slow.c, "\0unknown"]) - 1) < 1e-9


def test_keys_survive_packing():
    for keys in ([], [0], [5, 7, 2**39], [1, 2**52]):
        k = np.array(keys, np.uint64)
        assert (ngrams._unpack_keys(ngrams._pack_keys(k), len(k)) == k).all()
    n = np.array([0, 1, 300, 2**40])
    assert (ngrams._from_planes(ngrams._planes(n), 4) == n).all()


def test_empty_tables(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out, _ = ngrams.score_all(docs, F.lit(True))
    assert sorted((r.n_tokens, r.n_known) for r in out.collect()) == [(1, 0), (3, 0)]
    assert ngrams.score_all(docs.limit(0), F.lit(False))[0].count() == 0


def test_held_out_texts_score_better_than_the_base(spark):
    out = [r for r in op6_backoff_automaton(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(out) > 100 and sum(r.score for r in out) > sum(r.base_score for r in out)
