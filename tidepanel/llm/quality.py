"""Quality classifier: attention-based multiple-instance learning over a document's passages.

A document is a bag of passages of up to 64 words. Each passage is encoded from how its bytes follow each
other by kind, the shape of its words, their repetition and hashed words. A gated attention, learnt from
document labels alone, weighs the passages; the score is a logistic regression of the weighted passage
representation. Scoring reads each text once, where it lies; only the fitted weights (some thousand
numbers) are sent out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.lineage import spared
from tidepanel.llm.words import chunks, find_words, lean, span_hashes, text_bytes

PASSAGE = 64  # words
HASHED = 64
THRESHOLD = 0.7
SAMPLE = 4096  # labelled rows fitted on at most
SAMPLE_BYTES = 32 << 20  # bytes of whole texts fitted on at most, in all

_KINDS = np.full(256, 9, dtype=np.int64)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\x0b\x0c", ".,", "!?", "|", None, "#$%&*@^~+=<>")):
    if _chars:
        _KINDS[[ord(c) for c in _chars]] = _k
_KINDS[128:] = 11
_N = 12
FEATURES = _N * _N + 10 + HASHED


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts (float32) and the bounds of each text's passages.

    A text without words has one passage without features.
    """
    w = find_words(data, offsets, lower=False)
    words = np.diff(w.bounds)
    per_doc = np.maximum(-(-words // PASSAGE), 1)
    bounds = np.concatenate([[0], np.cumsum(per_doc)])
    total = int(bounds[-1])
    of_word = np.repeat(bounds[:-1], words) + (np.arange(len(w.starts)) - np.repeat(w.bounds[:-1], words)) // PASSAGE
    begin = np.repeat(offsets[:-1], per_doc)
    opening = np.flatnonzero(np.diff(of_word, prepend=-1))
    begin[of_word[opening]] = w.starts[opening]
    begin[bounds[:-1]] = offsets[:-1]
    sizes = np.diff(np.append(begin, len(data)))
    kind = _KINDS[data]
    out = np.zeros((total, FEATURES), dtype=np.float32)
    if len(data):
        pair = np.empty(len(data), dtype=np.int64)
        pair[:-1] = kind[:-1] * _N + kind[1:]
        pair[-1] = kind[-1] * _N + 4
        last = offsets[1:][np.diff(offsets) > 0] - 1
        pair[last] = kind[last] * _N + 4
        pair += np.repeat(np.arange(total) * (_N * _N), sizes)
        out[:, : _N * _N] = np.bincount(pair, minlength=total * _N * _N).reshape(total, -1) / np.maximum(sizes, 1)[:, None]
    if not len(w.starts):
        return out, bounds
    n = np.bincount(of_word, minlength=total).astype(np.float64)
    n1 = np.maximum(n, 1)
    length = w.ends - w.starts
    hashes = span_hashes(data, w.starts, w.ends)
    upper = (kind == 1).cumsum()
    uppers = upper[w.ends - 1] - upper[w.starts] + (kind[w.starts] == 1)
    doc = w.doc_of()
    with np.errstate(over="ignore"):
        _, first, where = np.unique(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True, return_inverse=True)
        _, first_in = np.unique(hashes + of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)
    count = lambda m: np.bincount(of_word, weights=m, minlength=total)
    mean = count(length) / n1
    seen = np.zeros(len(hashes))
    seen[first] = 1
    own = np.zeros(len(hashes))
    own[first_in] = 1
    tail = kind[w.ends - 1]
    shape = [mean / 10, np.sqrt(np.maximum(count(length.astype(np.float64) ** 2) / n1 - mean**2, 0)) / 10, count(length <= 2) / n1, count(length > 14) / n1, count(kind[w.starts] == 1) / n1]
    shape += [count(uppers == length) / n1, count((tail > 6)) / n1, count(own) / n1, count(seen) / n1, np.log1p(n) / 5]
    out[:, _N * _N : _N * _N + 10] = np.stack(shape, axis=1)
    bucket = (hashes & np.uint64(HASHED - 1)).astype(np.int64) + of_word * HASHED
    out[:, -HASHED:] = np.bincount(bucket, minlength=total * HASHED).reshape(total, -1) / n1[:, None]
    return out, bounds


class Attention:
    """Gated-attention pooling with a logistic score; all weights in ``params``."""

    def __init__(self, features: int = FEATURES, hidden: int = 32, gate: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)
        shape = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.params = {"W": shape(features, hidden), "b": np.zeros(hidden, np.float32), "V": shape(hidden, gate), "U": shape(hidden, gate), "w": shape(gate, 1)[:, 0], "c": shape(hidden, 1)[:, 0], "c0": np.zeros(1, np.float32)}
        self.center, self.scale = np.zeros(features, np.float32), np.ones(features, np.float32)

    def _forward(self, x: np.ndarray, bounds: np.ndarray) -> dict:
        p = self.params
        bag, begin = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), bounds[:-1]
        h = np.tanh(x @ p["W"] + p["b"])
        a1, a2 = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (a1 * a2) @ p["w"]
        e = np.exp(s - np.maximum.reduceat(s, begin)[bag])
        a = e / np.add.reduceat(e, begin)[bag]
        z = np.add.reduceat(a[:, None] * h, begin)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["c0"], -30, 30)))
        return {"bag": bag, "begin": begin, "h": h, "a1": a1, "a2": a2, "a": a, "z": z, "score": score}

    def score(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self._forward(np.clip((x - self.center) / self.scale, -8, 8), bounds)["score"].astype(np.float64)

    def fit(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 3e-3, decay: float = 2e-3, seed: int = 11) -> "Attention":
        self.center, self.scale = x.mean(0), x.std(0) + 1e-3
        x = np.clip((x - self.center) / self.scale, -8, 8)
        base = np.clip(y.mean(), 0.01, 0.99)
        self.params["c0"][0] = np.log(base / (1 - base))
        r, p = np.random.default_rng(seed), self.params
        m, v, t = {k: np.zeros_like(q) for k, q in p.items()}, {k: np.zeros_like(q) for k, q in p.items()}, 0
        for epoch in range(epochs):
            order = r.permutation(len(y))
            for at in range(0, len(y), batch):
                rows = order[at : at + batch]
                size = np.diff(bounds)[rows]
                own = np.concatenate([[0], np.cumsum(size)])
                xs = x[np.repeat(bounds[rows] - own[:-1], size) + np.arange(own[-1])]
                t += 1
                step = rate * (1 - epoch / epochs)
                for k, g in self._gradients(xs, own, y[rows]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= step * (m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8) + (decay * p[k] if k in "WVU" else 0)).astype(np.float32)
        return self

    def _gradients(self, x, bounds, y) -> dict:
        p, f = self.params, self._forward(x, bounds)
        bag, a, h = f["bag"], f["a"], f["h"]
        d = ((f["score"] - y) / len(y)).astype(np.float32)
        dz = d[:, None] * p["c"]
        da = (h * dz[bag]).sum(1)
        ds = a * (da - np.add.reduceat(a * da, f["begin"])[bag])
        g1 = ds[:, None] * p["w"] * f["a2"] * (1 - f["a1"] ** 2)
        g2 = ds[:, None] * p["w"] * f["a1"] * f["a2"] * (1 - f["a2"])
        dh = (a[:, None] * dz[bag] + g1 @ p["V"].T + g2 @ p["U"].T) * (1 - h**2)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ g1, "U": h.T @ g2, "w": (f["a1"] * f["a2"]).T @ ds, "c": f["z"].T @ d, "c0": d.sum(keepdims=True)}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Attention:
    """A classifier from the labelled rows of ``docs`` outside the held-out quarter (crc32 of the id mod 4 is 2).

    Fits on whole texts: of the labelled rows in the order of their hashed ids and texts the first ``sample``, as far as
    their texts have ``sample_bytes`` bytes together (a row that would exceed them is passed over). Rows that are alike in id and
    text count once. Null labels and ids don't count; of a document's labels the largest holds. Without labelled
    documents all scores are one half.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2)
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.octet_length(text).alias("n")).distinct()
    first = rows.join(known, "id").select(F.col("id").cast("string").alias("id"), "h", "n", F.col("y").cast("double").alias("y")).orderBy(F.xxhash64("id"), "id", "h").limit(sample).collect()
    chosen, left = [], sample_bytes
    for r in first:
        if r.n <= left:
            chosen.append((r.id, r.h, r.y))
            left -= r.n
    model = Attention()
    if not chosen:
        return model
    chosen = docs.sparkSession.createDataFrame(chosen, "id string, h long, y double")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in chunks(offsets):
                x, bounds = passages(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                bags = pa.array([x[s:e].astype("<f2").tobytes() for s, e in zip(bounds, bounds[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (1, 2, 3)), bags], names=["id", "h", "y", "bag"])

    texts = docs.select(text.alias("text"), F.col(id_col).cast("string").alias("id"), F.xxhash64(text).alias("h")).join(F.broadcast(chosen), ["id", "h"])
    got = texts.dropDuplicates(["id", "h"]).select("text", "id", "h", "y").mapInArrow(run, "id string, h long, y double, bag binary").toPandas().sort_values(["id", "h"])
    bags = [np.frombuffer(b, dtype="<f2").reshape(-1, FEATURES).astype(np.float32) for b in got.bag]
    bounds = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return model.fit(np.concatenate(bags), bounds, got.y.to_numpy(dtype=np.float64))


def score(docs: DataFrame, model: Attention, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all) and ``_score``: the probability that a document is good, from its whole text.

    Null, empty and blank texts get the score of a passage without features. All rows stay.
    """
    keep = docs.columns if keep is None else keep
    at, kept = docs.columns.index(text_col), [docs.columns.index(c) for c in keep]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            out = [np.zeros(0)]
            for a, b in chunks(offsets):
                out.append(model.score(*passages(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(np.concatenate(out))], names=[*keep, "_score"])

    return docs.mapInArrow(run, docs.select(*keep).schema.add("_score", "double"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, with their columns, whatever their names."""
    own = spared(docs, "_score")
    return score(own, fit(own, labels)).where(F.col("_score") >= threshold).drop("_score").toDF(*docs.columns)
