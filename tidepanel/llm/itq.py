"""Embedding near-duplicates by iterative quantisation.

Unit vectors, centred and rotated so that the signs of their coordinates lose least, become binary codes.
Codes are cut into the tables of a multi-index: two vectors are candidates if they agree in all bits of some table.
Candidates whose first 64 bits are close are reranked by the cosine of the original vectors in double precision.
Equal vectors of one label are one vertex from the start, counted and not paired.

The layout follows the data. A table has about log2(n) bits, n being the largest label's distinct vectors, so a bucket
doesn't grow with them. There are as many tables as it takes to find a pair at the threshold with a probability of
``FOUND``, from the angle that such a pair has after centring (where
a common direction makes up most of the vectors, they aren't centred): closer pairs are found almost surely. Recall figures
are in the README.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.lineage import components, cut
from tidepanel.llm.vectors import by_length, matrix, sample, usable

BITS = 64  # compared before the rerank
FOUND = 0.98
CENTRED = 0.2  # bits that differ at most for the mean to be taken away: beyond, vectors are so alike that centring hides the near pairs
SAMPLE = 16384  # vectors that rotations are learnt from at most
ROUNDS = 40
COSINE = 0.93


def flips(spread: float, threshold: float = COSINE) -> float:
    """How likely a bit differs between unit vectors at ``threshold`` whose squared distance from the mean is ``spread``."""
    return float(np.arccos(np.clip(1 - (1 - threshold) / max(spread, 1e-9), -0.8, 1)) / np.pi)


def layout(n: int, flip: float, found: float = FOUND) -> tuple[int, int, int]:
    """Bits of a table, number of tables, and in how many of 64 bits candidates may differ (five standard deviations above the mean)."""
    width = int(np.clip(np.ceil(np.log2(max(n, 1))), 8, 40))
    tables = max(2, int(np.ceil(np.log(1 - found) / np.log1p(-((1 - max(flip, 1e-3)) ** width)))))
    return width, tables, int(np.ceil(BITS * flip + 5 * np.sqrt(BITS * flip * (1 - flip))))


class Rotation:
    """Codes of unit vectors of one length: ``sign((x - mean) @ turn)``; ``flip`` is how likely their bits differ at the threshold."""

    def __init__(self, x: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 5, threshold: float = COSINE):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = x.shape[1]
        rng = np.random.default_rng(seed)
        self.mean = x.mean(0) if len(x) > d else np.zeros(d)
        self.flip = flips(float(np.quantile(((x - self.mean) ** 2).sum(1), 0.1)), threshold) if len(x) > d else flips(1.0, threshold)
        if self.flip > CENTRED:
            self.mean, self.flip = np.zeros(d), flips(1.0, threshold)
        _, _, axes = np.linalg.svd((x - self.mean).T @ (x - self.mean))
        blocks = []
        while sum(b.shape[1] for b in blocks) < bits:  # short vectors are rotated more than once
            k = min(d, bits - sum(b.shape[1] for b in blocks))
            main = axes[:k].T
            turn = np.linalg.qr(rng.standard_normal((k, k)))[0]
            v = (x - self.mean) @ main
            for _ in range(rounds if len(x) > d else 0):
                u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
                turn = (u @ w).T
            blocks.append(main @ turn)
        self.turn = np.concatenate(blocks, axis=1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Rows of bits."""
        x = x.astype(np.float64)
        return (x / np.linalg.norm(x, axis=1, keepdims=True) - self.mean) @ self.turn >= 0


def first_bits(code: np.ndarray) -> np.ndarray:
    """The first 64 bits of each code, as one integer."""
    return np.packbits(code[:, :BITS], axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def table_parts(code: np.ndarray, width: int, tables: int) -> np.ndarray:
    """The bits of each table as an integer: rows x tables."""
    bits = code[:, : width * tables].reshape(len(code), tables, width).astype(np.int64)
    return bits @ (1 << np.arange(width, dtype=np.int64))


def candidates(coded: DataFrame, near: int, width: int) -> DataFrame:
    """Pairs ``a`` < ``b`` of (``id``, ``grp``, ``code``, ``parts``) in one group whose codes meet in a table and are close.

    A pair that meets in a table within the first 64 bits isn't made again in later ones.
    """
    entries = coded.select("id", "grp", "code", F.posexplode("parts").alias("t", "part"))
    met = entries.withColumnsRenamed({"id": "a", "code": "code_a"}).join(entries.withColumnsRenamed({"id": "b", "code": "code_b"}), ["t", "part", "grp"])
    earlier = " OR ".join(f"(t > {t} AND ((code_a ^ code_b) & {((1 << width) - 1 << t * width) - (1 << 64 if (t + 1) * width == BITS else 0)}L) = 0)" for t in range(BITS // width))
    return met.where(f"a < b AND bit_count(code_a ^ code_b) <= {near} AND NOT ({earlier})").select("a", "b").distinct()


def links(classes: DataFrame, threshold: float = COSINE) -> DataFrame:
    """Pairs ``a`` < ``b`` of distinct vectors (``id``, ``grp``, ``v``) in one group with a cosine of at least ``threshold``."""
    spark = classes.sparkSession
    samples = sample(classes, "v", "id", SAMPLE)
    flip = max([Rotation(m, bits=1, rounds=0, threshold=threshold).flip for m in samples], default=0.0)
    largest = classes.groupBy("grp").count().agg(F.max("count")).first()[0] or 1
    width, tables, near = layout(largest, flip)
    bits = max(BITS, width * tables)
    sent = spark.sparkContext.broadcast({m.shape[1]: Rotation(m, bits) for m in samples})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, parts = np.zeros(len(batch), np.uint64), np.zeros((len(batch), tables), np.int64)
            for rows, m in by_length(batch.column(2)):
                own = (sent.value.get(m.shape[1]) or Rotation(np.eye(m.shape[1])[:1], bits)).codes(m)
                code[rows], parts[rows] = first_bits(own), table_parts(own, width, tables)
            lists = pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * tables, parts.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code.view(np.int64)), lists], names=["id", "grp", "code", "parts"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(len(batch), dtype=bool)
            for rows, x in by_length(batch.column(2)):
                y = matrix(batch.column(3).take(pa.array(rows))).astype(np.float64)
                x = x.astype(np.float64)
                good[rows] = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))) >= threshold
            yield batch.select(["a", "b"]).filter(pa.array(good))

    coded = cut(classes.select("id", "grp", "v").mapInArrow(encode, "id long, grp long, code long, parts array<long>"))
    pairs = candidates(coded, near, width)
    vectors = classes.select("id", "v")
    both = pairs.join(vectors.toDF("a", "va"), "a").join(vectors.toDF("b", "vb"), "b").select("a", "b", "va", "vb")
    return both.mapInArrow(verify, "a long, b long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = COSINE) -> DataFrame:
    """(``id_col``, ``n_links``, ``component_id``, ``kept``) for every row of ``vectors``.

    Rows link if their labels are equal and not null and their vectors' cosine is at least ``threshold``.
    ``n_links`` counts the other rows linked to a row, ``component_id`` is the smallest id reachable. Null,
    empty and zero vectors and those with null or non-finite components link with nothing, nor do vectors
    of different lengths. Rows without an id take part; other columns are ignored; an empty table gives
    no rows.
    """
    kind = vectors.select(id_col).schema[0].dataType
    rows = vectors.select(F.col(id_col).alias("vec"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    rows = rows.withColumn("key", F.when(usable("v") & F.col("label").isNotNull(), F.xxhash64("label", F.size("v"), "v")))
    grouped = rows.where("key IS NOT NULL").groupBy("key", "label", "v").agg(F.min("vec").alias("first"), F.count("*").alias("copies"))
    classes = cut(grouped.select(F.monotonically_increasing_id().alias("id"), F.xxhash64("label", F.size("v")).alias("grp"), "key", "label", "v", "first", "copies"))
    pairs = cut(links(classes, threshold))
    both = pairs.unionByName(pairs.selectExpr("b AS a", "a AS b"))
    sizes = classes.select(F.col("id").alias("b"), "copies")
    linked = both.join(sizes, "b").groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("others"))
    reach = components(pairs).withColumnsRenamed({"id": "vertex"})
    told = classes.join(linked, "id", "left").join(reach, F.col("id") == F.col("vertex"), "left")
    told = told.select("key", "label", "v", "first", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    told = cut(told)
    least = told.groupBy("component").agg(F.min("first").alias("least"))
    told = told.join(least, "component").select(F.col("key").alias("k"), F.col("label").alias("l"), F.col("v").alias("w"), "n_links", "least")
    out = rows.join(told, (F.col("key") == F.col("k")) & (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    component = F.when(F.col("key").isNull(), F.col("vec")).otherwise(F.col("least")).cast(kind)
    out = out.select(F.col("vec").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
