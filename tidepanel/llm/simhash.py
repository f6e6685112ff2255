"""SimHash near-duplicates by Golay-code fuzzy hashing.

Two 64-bit fingerprints that differ in at most two bits agree wholly in one of three segments, and differ
in at most one bit in the segment that follows it round the ring of three (if the clean segment is chosen
well: with errors in both others each holds one, with errors in one other the ring holds a neighbouring
clean pair). So a key joins the clean segment's bits with a key of the next segment that forgives one bit:
the index of the nearest codeword of the perfect binary Golay code [23, 12, 7]. A fingerprint stores the
index of its own segment and looks up the indices of all words within one bit of it, which are one index
or six. Candidates are then verified on all 64 bits, so the links are exactly those of brute force.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.lineage import components, cut, spared
from tidepanel.llm.words import SPACE, chunks, find_words, lean, text_bytes

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width
_PART = 1 << 15  # shingles summed before 16-bit lanes could overflow


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = 3) -> np.ndarray:
    """The SimHash of each text as uint64; see :func:`with_fingerprints`."""
    w = find_words(data, offsets)
    text = w.data
    text[SPACE[text]] = 32
    keep = text != 32
    after = w.ends[w.ends < len(text)]
    keep[after] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    flat = text[keep].tobytes()
    n_words = np.diff(w.bounds)
    n = np.where(n_words >= shingle, n_words - shingle + 1, (n_words > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(n)])
    first = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n) + np.repeat(w.bounds[:-1], n)
    last = np.minimum(first + shingle, np.repeat(w.bounds[1:], n)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(flat[s:e], SEED) for s, e in zip(place[w.starts[first]].tolist(), place[w.ends[last]].tolist())], dtype=np.uint64)
    out = np.zeros(len(n), dtype=np.uint64)
    if not len(h):
        return out
    parts = np.maximum((n + _PART - 1) // _PART, 0)
    of = np.repeat(np.arange(len(n)), parts)
    begin = bounds[of] + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * _PART
    ones = np.uint64(0x0001000100010001)
    for k in range(16):
        lanes = np.add.reduceat((h >> np.uint64(k)) & ones, begin)
        for lane in range(4):
            count = np.bincount(of, weights=((lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.float64), minlength=len(n))
            out |= (2 * count > n).astype(np.uint64) << np.uint64(16 * lane + k)
    return out


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(``id_col``, ``fp`` long, the columns ``keep``): the SimHash of each whole text.

    Words are maximal runs without space and \\x09-\\x0D, A-Z lowered; shingles of ``shingle`` words with
    repeats, joined by one space (a shorter text is one shingle); a bit is set if it is in over half of
    the shingles' XXH64 (seed 42). Null, empty and blank texts have fingerprint 0.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in chunks(offsets):
                fp = fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fp.view(np.int64)), *(batch.column(2 + i).slice(a, b - a) for i in range(len(keep)))], names=["id", "fp", *keep])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col), *keep)
    kinds = ", ".join([f"id {slim.schema[0].dataType.simpleString()}", "fp long", *(f"{c} {slim.schema[c].dataType.simpleString()}" for c in keep)])
    return slim.mapInArrow(run, kinds).withColumnRenamed("id", id_col)


@cache
def _nearest() -> np.ndarray:
    """For each syndrome of the Golay code with g(x) = x^11+x^10+x^6+x^5+x^4+x^2+1, the error of least weight."""
    errors = np.zeros(1 << 11, dtype=np.int64)
    bits = [1 << i for i in range(23)]
    words = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i]), *(a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])]
    words = np.array(words, dtype=np.int64)
    errors[_syndrome(words)] = words
    return errors


def _syndrome(words: np.ndarray) -> np.ndarray:
    left = words.copy()
    for k in range(22, 10, -1):
        left ^= ((left >> k) & 1) * (0b110001110101 << (k - 11))
    return left


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the codeword nearest to each 23-bit word; none is further than three bits."""
    return (words ^ _nearest()[_syndrome(words)]) >> 11


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stored keys (rows x 3), then row and key of each lookup; see the module's docstring."""
    bits = fp.view(np.uint64)
    parts = [((bits >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    stored, rows, lookups = [], [], []
    for k in range(3):
        clean, fuzzy, width = parts[k], parts[(k + 1) % 3], SEGMENTS[(k + 1) % 3][1]
        base = (clean << 14) | (k << 12)
        stored.append(base | codeword_index(fuzzy))
        near = np.stack([codeword_index(fuzzy), *(codeword_index(fuzzy ^ (1 << i)) for i in range(width))], axis=1)
        near.sort(axis=1)
        new = np.ones(near.shape, dtype=bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(new)
        rows.append(r)
        lookups.append(base[r] | near[r, c])
    return np.stack(stored, axis=1), np.concatenate(rows), np.concatenate(lookups)


def links(classes: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of the distinct fingerprints ``fp`` that differ in one or two bits."""

    def store(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            keys = fuzzy_keys(fp)[0]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fp, 3))], names=["key", "a"])

    def look(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            _, rows, keys = fuzzy_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], names=["key", "b"])

    fp = classes.select("fp")
    stored, looked = fp.mapInArrow(store, "key long, a long"), fp.mapInArrow(look, "key long, b long")
    return stored.join(looked, "key").where("a < b AND bit_count(a ^ b) <= 2").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(``id_col``, ``fp`` long, ``component_id``, the columns ``keep``) for every row of ``docs``.

    ``component_id`` is the smallest id reachable over fingerprints that differ in at most two bits; equal
    fingerprints are one vertex, so copies are never paired with each other. Rows without an id take part
    and get the smallest id of their component (null if none there has one); repeated ids keep their
    rows; an empty table gives no rows; further columns are ignored.
    """
    kind = docs.select(id_col).schema[0].dataType
    prints = cut(with_fingerprints(docs, id_col, text_col, keep=keep))
    classes = cut(prints.groupBy("fp").agg(F.min(id_col).alias("first")))
    reach = components(links(classes))
    joined = classes.join(reach, F.col("fp") == F.col("id"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = joined.groupBy("component").agg(F.min("first").alias("smallest"))
    label = joined.join(smallest, "component").select("fp", F.col("smallest").cast(kind).alias("component_id"))
    return prints.join(label, "fp").select(id_col, "fp", "component_id", *keep)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those whose near-duplicate group has a smaller ``doc_id``.

    Of repeated rows of the kept id one stays for each text. A row without an id stays only if its group has no id.
    Other columns may have any names; an empty table stays empty.
    """
    own = spared(docs, "_copy", "_kept", "_hash").withColumn("_copy", F.xxhash64(F.lit(SEED), "text"))
    one = near_duplicates(own, keep=("_copy",)).where("doc_id = component_id OR component_id IS NULL")
    one = cut(one.groupBy(F.col("doc_id").alias("_kept"), F.col("_copy").alias("_hash")).agg(F.count("*").alias("_rows")))
    kept = own.join(one.select("_kept", "_hash"), F.col("doc_id").eqNullSafe(F.col("_kept")) & (F.col("_copy") == F.col("_hash")), "left_semi")
    if not one.where("_rows > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "_copy"])
    return kept.drop("_copy").toDF(*docs.columns)
