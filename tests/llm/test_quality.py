import zlib

import numpy as np

from tidepanel.llm import quality
from tidepanel.llm.queries import op1_attention_quality
from tidepanel.llm.words import text_bytes


def test_passages_split_at_64_words():
    import pyarrow as pa

    texts = ["", None, "one", " ".join(["w"] * 64), " ".join(["w"] * 65) + "\n", "é " * 1000, "\n \t"]
    x, bounds = quality.passages(*text_bytes(pa.array(texts)))
    assert np.diff(bounds).tolist() == [1, 1, 1, 1, 2, 16, 1] and x.shape == (23, quality.FEATURES) and np.isfinite(x).all()
    assert not x[0].any() and not x[1].any()
    whole, _ = quality.passages(*text_bytes(pa.array(["é " * 1000])))
    assert np.allclose(whole, x[6:22])


def test_gradients_match_finite_differences():
    r = np.random.default_rng(0)
    model = quality.Attention(features=5, hidden=4, gate=3)
    model.params = {k: v.astype(np.float64) for k, v in model.params.items()}
    x, bounds, y = r.standard_normal((9, 5)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = model._forward(x, bounds)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name, g in model._gradients(x, bounds, y).items():
        p, flat = model.params[name], np.asarray(g).ravel()
        for k in range(0, p.size, max(1, p.size // 5)):
            old = p.flat[k]
            p.flat[k] = old + 1e-5
            up = loss()
            p.flat[k] = old - 1e-5
            down = loss()
            p.flat[k] = old
            assert abs((up - down) / 2e-5 - flat[k]) < 1e-5


def test_held_out_accuracy_and_columns(spark):
    d = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in op1_attention_quality(spark, d).collect()}
    assert len(out) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for i, r in out.items())
    told = [(r.quality, out[r.doc_id]) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    held = [(q, r.predicted) for q, r in told if r.held_out]
    assert sum(q == p for q, p in held) / len(held) > 0.93


def slow_score(model, text):
    """The score of a text, one passage and one unit at a time."""
    import math

    import pyarrow as pa

    x, _ = quality.passages(*text_bytes(pa.array([text])))
    p, units = model.params, []
    for row in x:
        row = [min(8.0, max(-8.0, float(v - c) / float(s))) for v, c, s in zip(row, model.center, model.scale)]
        h = [math.tanh(sum(v * float(p["W"][i, j]) for i, v in enumerate(row)) + float(p["b"][j])) for j in range(len(p["b"]))]
        gate = 0.0
        for g in range(len(p["w"])):
            t = math.tanh(sum(v * float(p["V"][i, g]) for i, v in enumerate(h)))
            u = 1 / (1 + math.exp(-sum(v * float(p["U"][i, g]) for i, v in enumerate(h))))
            gate += t * u * float(p["w"][g])
        units.append((math.exp(gate), h))
    z = [sum(e * h[j] for e, h in units) / sum(e for e, _ in units) for j in range(len(p["b"]))]
    return 1 / (1 + math.exp(-sum(a * float(b) for a, b in zip(z, p["c"])) - float(p["c0"][0])))


def test_scores_against_a_slow_forward_pass(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    got = {r.doc_id: r["_score"] for r in quality.score(docs, model).collect()}
    query = {r.doc_id: r.score for r in op1_attention_quality(spark, d).collect()}
    for r in docs.limit(12).collect():
        assert abs(got[r.doc_id] - slow_score(model, r.text)) < 1e-4 and abs(query[r.doc_id] - got[r.doc_id]) < 1e-6


def test_the_sample_is_bounded_in_rows_and_bytes_whatever_ids_repeat(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.Attention, "fit", lambda self, x, bounds, y: seen.append((len(x), np.diff(bounds).tolist(), y.tolist())) or self)
    one, two = [i for i in range(4, 30) if zlib.crc32(str(i).encode()) % 4 != 2][:2]
    rows = [(one, f"text {i % 50} " + "word " * 200) for i in range(500)] + [(two, "long " * 3000)] + [(100 + i, "a " * 10) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(one, 1), (two, 0)] + [(9000 + i, 0) for i in range(5000)] + [(100 + i, 0) for i in range(30)], "doc_id long, quality int")
    quality.fit(docs, labels)
    held = {i for i in range(100, 130) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert len(seen[0][2]) == 51 + 30 - len(held) and max(seen[0][1]) == 47  # whole texts
    quality.fit(docs, labels, sample=20)
    assert len(seen[1][2]) == 20
    quality.fit(docs, labels, sample_bytes=5000)
    assert max(seen[2][1]) < 47 and len(seen[2][2]) >= 3
    null = spark.createDataFrame([(None, "text")], "doc_id long, text string")
    assert quality.score(null, quality.Attention()).count() == 1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (1, "fine words here. " * 9, 3.0), (2, "X!! " * 50000, 4.0), (3, " ", 5.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (1, 1), (1, 0), (2, 0)], "doc_id long, quality int")
    out = quality.score(docs, quality.fit(docs, labels))
    assert out.columns == [*docs.columns, "_score"] and out.count() == 5
    none = quality.score(docs, quality.fit(docs, labels.limit(0)))
    assert none.count() == 5 and quality.keep_good(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_columns_named_like_the_operators_own(spark):
    plain = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs = plain.selectExpr("*", "doc_id AS _score", "1 AS id", "2 AS y", "3 AS bag", "4 AS quality")
    out = quality.keep_good(docs, labels)
    assert out.columns == docs.columns
    rows = out.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in quality.keep_good(plain, labels).collect()}
    assert all((r["_score"], r.id, r.y, r.bag, r.quality) == (r.doc_id, 1, 2, 3, 4) for r in rows)
