"""Substring deduplication by compact windows.

A document is the sequence of its anchors, its runs of 13 words. Under a hash function, the Cartesian tree of the
anchors' hashes groups all subsequences with the same least anchor into one compact window: left bound, place of the
least anchor, right bound. Passages that are alike in 25 words have 13 anchors in common, so a window with the same
signature around the same least anchor, whatever the hash function.

That is enough for all passages of 50 words whose five-word shingles have a Jaccard similarity of 0.8. Each stretch in
which two such passages differ takes four shingles or more from one and five or more from the other, so with m stretches
at least 36 m shingles are alike (and 41 of 46 with one), in m + 1 runs. The longest run has 21 shingles at least: 25 words.

An interval join pairs each window with the first document's that has its signature, if both windows, aligned at their
least anchors, have room for such a run. What is paired is verified on the words around it. The first document may hold
only a part of what two later ones share. So where three documents or more have a signature, or one
repeats it, those that no verified passage
covers go on: their runs of 25 and of 50 words around the anchor are grouped by a hash of the whole run, and each meets the
first document that has it. So a passage of 50 words that is exactly alike is always found, and near copies are unless an
earlier document holds each of the runs of 25 words that they share, without holding the passage.

No pairs are made within a group: each window and each run meets one other. Rows per document follow its length, and hot
signatures meet in a join of rows, never in one list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.lineage import cut, spared, written
from tidepanel.llm.words import chunks, find_words, lean, mix, run_hashes, shingle_hashes, span_hashes, text_bytes

SHINGLE = 5
WORDS = 50
WIDTH = WORDS - SHINGLE + 1  # shingles in the shortest passage
SIMILAR = 0.8
ANCHOR = 13  # words
ALIKE = 25  # words that similar passages have in one run at least
HASHES = 1
BLOCK, MARGIN = 128, 64  # words of a first document that are compared at once, and those around them
GAP = 10  # shingles that differ between two stretches of one passage: two changed words
_SLICE = 1 << 21


def compact_windows(keys: np.ndarray, bounds: np.ndarray, width: int = ALIKE - ANCHOR + 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left bound, place and right bound (inclusive) of each compact window of at least ``width`` anchors, up to ``width`` - 1 from the place.

    These are the nodes of each text's Cartesian tree (of equal keys the leftmost is the parent) whose subtree is that
    wide. A node is one exactly if it is the least of some run of ``width`` anchors, so sliding minima find the places,
    and the first and last of these runs its bounds, as far as runs of that width can tell.
    """
    low = np.uint64(_SLICE * 2 - 1)
    inside = np.ones(len(keys), dtype=bool)
    for k in range(1, width):  # runs that would leave their text
        at = bounds[1:] - k
        inside[at[at >= bounds[:-1]]] = False
    found = [np.zeros((3, 0), np.int64)]
    for a in range(0, len(keys), _SLICE):
        part = keys[a : a + _SLICE + width - 1]
        if len(part) < width:
            break
        part = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            part = np.minimum(part[:-span], part[span:])
            span *= 2
        if span < width:
            part = np.minimum(part[: span - width], part[width - span :])
        first = np.flatnonzero(inside[a : a + len(part)])
        place = (part[first] & low).astype(np.int64)
        begin = np.flatnonzero(np.diff(place, prepend=-1))
        end = np.append(begin[1:], len(place))[: len(begin)] - 1
        found.append(np.stack([first[begin], place[begin], first[end] + width - 1]) + a)
    left, place, right = np.concatenate(found, axis=1)
    new = np.flatnonzero(np.diff(place, prepend=-1))  # a place on both sides of a cut
    return (np.minimum.reduceat(left, new), place[new], np.maximum.reduceat(right, new)) if len(new) else (left, place, right)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))


def windows(docs: DataFrame, hashes: int = HASHES) -> DataFrame:
    """(``sig``, ``key``, ``at``): signature, document, and place << 9 | repeated << 8 | room to the left << 4 | to the right.

    A document has one row for each signature, the leftmost place's, with a mark if others repeat it: what a text
    repeats without end makes no large group.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy()
            data, offsets = text_bytes(batch.column(1))
            for a, b in chunks(offsets):
                w = find_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                anchors, bounds = shingle_hashes(span_hashes(w.data, w.starts, w.ends), w.bounds, ANCHOR)
                for k in range(hashes):
                    keys = mix(anchors, 101 + k)
                    left, place, right = compact_windows(keys, bounds)
                    doc = np.searchsorted(bounds, place, side="right") - 1
                    with np.errstate(over="ignore"):
                        _, i, often = np.unique(keys[place] + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True, return_counts=True)
                    at = (place[i] - bounds[doc[i]]) << 9 | (often > 1).astype(np.int64) << 8 | (place[i] - left[i]) << 4 | (right[i] - place[i])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[place[i]].view(np.int64)), pa.array(names[a:b][doc[i]]), pa.array(at)], names=["sig", "key", "at"])

    return docs.select("key", "text").mapInArrow(run, "sig long, key long, at long")


def codes(docs: DataFrame) -> DataFrame:
    """(``doc``, ``key``, ``codes``): 16 bits of each word's hash."""
    kind = docs.schema["doc"].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for a, b in chunks(offsets):
                w = find_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                raw = span_hashes(w.data, w.starts, w.ends).astype("<u2").tobytes()
                out = [raw[2 * s : 2 * e] for s, e in zip(w.bounds.tolist(), w.bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(out, pa.binary())], names=["doc", "key", "codes"])

    return docs.mapInArrow(run, f"doc {kind}, key long, codes binary")


def _shingles(raw: bytes) -> np.ndarray:
    return run_hashes(np.frombuffer(raw, dtype="<u2").astype(np.uint64), SHINGLE)


def shared_passages(a: np.ndarray, b: np.ndarray, width: int = WIDTH, similar: float = SIMILAR) -> list[tuple[int, int, int]]:
    """(first, last + 1, first in b): stretches of at least ``width`` shingles of ``a`` that are near copies of a stretch of ``b``."""
    if len(a) < width or len(b) < width:
        return []
    order = np.argsort(b, kind="stable")
    ordered = b[order]
    at = np.searchsorted(ordered, a)
    at[at == len(b)] = 0
    ia = np.flatnonzero(ordered[at] == a)
    if len(ia) < width * similar:
        return []
    at = at[ia]
    often = np.searchsorted(ordered, a[ia], side="right") - at

    def aligned(s: int, e: int) -> np.ndarray:
        """Where the shingles ``s`` to ``e`` stand in b: of several places the one nearest to the most frequent diagonal."""
        n = often[s:e]
        if n.max() == 1:
            return order[at[s:e]]
        first = np.cumsum(n) - n
        which = np.repeat(np.arange(e - s), n)
        places = order[np.arange(n.sum()) + np.repeat(at[s:e] - first, n)]
        diagonal = places - ia[s:e][which]
        values, counts = np.unique(diagonal, return_counts=True)
        nearest = np.lexsort((np.abs(diagonal - values[counts.argmax()]), which))
        return places[nearest[first]]

    gaps = np.diff(ia)
    out, todo = [], [(s, e) for s, e in zip([0, *(np.flatnonzero(gaps > GAP) + 1)], [*(np.flatnonzero(gaps > GAP) + 1), len(ia)])]
    while todo:
        s, e = todo.pop()
        if ia[e - 1] - ia[s] + 1 < width:
            continue
        ib = aligned(s, e)
        if ia[e - 1] - ia[s] == ib[-1] - ib[0] == e - s - 1 and (e - s < 3 or (np.diff(ib) == 1).all()):  # alike
            out.append((int(ia[s]), int(ia[e - 1]) + 1, int(ib[0])))
            continue
        mine = np.unique(a[ia[s] : ia[e - 1] + 1])
        theirs = np.unique(b[ib.min() : ib.max() + 1])
        both = len(np.intersect1d(mine, theirs, assume_unique=True))
        if both >= similar * (len(mine) + len(theirs) - both):
            out.append((int(ia[s]), int(ia[e - 1]) + 1, int(ib.min())))
        elif (widest := gaps[s : e - 1]).size and widest.max() > 1:
            cut_at = s + 1 + int(widest.argmax())
            todo += [(s, cut_at), (cut_at, e)]
        elif len(theirs) > len(mine):  # a run without gaps whose shingles repeat in b
            out.append((int(ia[s]), int(ia[e - 1]) + 1, int(ib.min())))
    return out


def compared(pairs: DataFrame, coded: DataFrame) -> DataFrame:
    """Passages of documents ``key`` that stand in a ``block`` of ``source``: what :func:`shared_passages` finds in the codes of both, one row of ``coded`` each."""
    wanted = pairs.groupBy(F.col("source").alias("key")).agg(F.collect_set("block").alias("blocks"))
    kind = coded.schema["doc"].dataType.simpleString()

    @lean
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for key, doc, raw, numbers in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for k in numbers:
                    first = max(0, k * BLOCK - MARGIN)
                    for column, value in zip(rows, (key, k, doc, first, raw[2 * first : 2 * ((k + 1) * BLOCK + MARGIN + SHINGLE - 1)])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], batch.column(1).type), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.binary())], names=["source", "block", "source_id", "first", "theirs"])

    sources = coded.join(wanted, "key").select("key", "doc", "codes", "blocks")
    sources = sources.mapInArrow(blocks, f"source long, block int, source_id {kind}, first long, theirs binary")

    @lean
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            own = batch.column(2)
            for i, (key, doc, source_id, first, theirs) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5)))):
                if key != last:
                    last, mine = key, _shingles(own[i].as_py())
                for s, e, at in shared_passages(mine, _shingles(theirs)):
                    for column, value in zip(rows, (doc, key, s, e + SHINGLE - 1, source_id, first + at)):
                        column.append(value)
            kinds = (batch.column(1).type, pa.int64(), pa.int64(), pa.int64(), batch.column(3).type, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["doc_id", "key", "first_word", "end_word", "source_id", "source_word"])

    sides = pairs.join(sources, ["source", "block"]).join(coded, "key").select("key", "doc", "codes", "source_id", "first", "theirs")
    return sides.mapInArrow(verify, f"doc_id {kind}, key long, first_word long, end_word long, source_id {kind}, source_word long")


def runs(open_places: DataFrame) -> DataFrame:
    """(``run``, ``key``, ``at``): hash and leftmost first word of each run of ``ALIKE`` or ``WORDS`` words around an anchor that no span covers.

    ``open_places`` has (``key``, ``codes``, ``places``, ``spans``): where the anchors begin, and passages that are known.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, key in enumerate(batch.column(0).to_pylist()):
                words = np.frombuffer(batch.column(1)[i].as_py(), dtype="<u2").astype(np.uint64)
                anchors = run_hashes(words, ANCHOR)
                places = np.flatnonzero(np.isin(anchors, anchors[batch.column(2)[i].values.to_numpy()]))  # repeated ones too
                known = np.zeros(len(words) + 1, dtype=np.int64)
                for s in batch.column(3)[i].as_py() or ():
                    known[s["first_word"] : s["end_word"]] = 1
                known = np.concatenate([[0], np.cumsum(known)])
                places = places[known[places + ANCHOR] - known[places] < ANCHOR]
                for size in (ALIKE, WORDS) if len(places) else ():
                    n = len(words) - size + 1
                    if n <= 0:
                        continue
                    change = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(change, np.clip(places + ANCHOR - size, 0, n), 1)
                    np.add.at(change, np.clip(places + 1, 0, n), -1)
                    at = np.flatnonzero(np.cumsum(change[:n]) > 0)
                    found, first = np.unique(run_hashes(words, size)[at].view(np.int64), return_index=True)
                    at = at[first]
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(at), key)), pa.array(at, pa.int32())], names=["run", "key", "at"])

    return open_places.select("key", "codes", "places", "spans").mapInArrow(run, "run long, key long, at int")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``key``, ``first_word``, ``end_word``, ``source_id``, ``source_word``, ``source_ids``): passages that earlier documents have.

    Passages are of at least 50 words (A-Z lowered), with five-word shingles of a Jaccard similarity of 0.8
    or more to a source's; overlapping ones are one. ``source_ids`` lists all sources found for it, the first
    of them is ``source_id``, where the passage begins at ``source_word``. Of documents that share a passage the one with the
    least ``key`` (a hash of id and text) is earlier and keeps it, so every passage stays somewhere. Passages
    that only one document repeats don't count, nor do rows that are alike in id and text (they share a key).
    Null ids take part; null, empty and short texts have no passages; other columns are ignored.
    """
    keyed = _keyed(docs, id_col, text_col)
    found = windows(keyed).repartition("sig")  # one shuffle for groups and join
    least = F.min(F.struct("key", "at"))
    groups = found.groupBy("sig").agg(least.alias("least"), F.max("key").alias("most"), ((F.count("*") > 2) | F.bool_or(F.expr("at & 256 > 0"))).alias("many")).where("least.key < most")
    room = f"((at | least.at) & 256 > 0 OR least(at >> 4 & 15, least.at >> 4 & 15) + least(at & 15, least.at & 15) + 1 >= {ALIKE - ANCHOR + 1})"
    shared = found.join(groups, "sig").selectExpr("key", "IF(many, CAST(at >> 9 AS INT), NULL) AS place", f"IF(key <> least.key AND {room}, least.key, NULL) AS source", f"CAST((least.at >> 9) DIV {BLOCK} AS INT) AS block")
    shared = written(shared.where("place IS NOT NULL OR source IS NOT NULL"))
    tried = cut(shared.where("source IS NOT NULL").select("key", "source", "block").distinct())
    places = shared.where("place IS NOT NULL").groupBy("key").agg(F.collect_set("place").alias("places"))
    concerned = tried.select("key").union(tried.select("source")).union(shared.where("place IS NOT NULL").select("key")).distinct()
    coded = written(codes(keyed).join(concerned, "key", "left_semi").dropDuplicates(["key"]))
    parts = written(compared(tried, coded))
    spans = parts.groupBy("key").agg(F.collect_list(F.struct("first_word", "end_word")).alias("spans"))
    whole = runs(coded.join(places, "key").join(spans, "key", "left")).repartition("run")
    groups = whole.groupBy("run").agg(least.alias("least"), F.max("key").alias("most")).where("least.key < most")
    pairs = whole.join(groups, "run").where("key <> least.key").selectExpr("key", "least.key AS source", f"CAST(least.at DIV {BLOCK} AS INT) AS block").distinct()
    pairs = cut(pairs.join(tried, ["key", "source", "block"], "left_anti"))
    parts = parts.unionByName(compared(pairs, coded))
    span = F.struct("first_word", "end_word", "source_id", "source_word", F.array("source_id").alias("source_ids"))
    spans = parts.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_set(span)).alias("s"))
    joined = F.expr(
        """aggregate(s, array_repeat(s[0], 0), (got, x) ->
             IF(size(got) > 0 AND x.first_word <= element_at(got, -1).end_word,
                concat(slice(got, 1, size(got) - 1), array(named_struct('first_word', element_at(got, -1).first_word, 'end_word', greatest(element_at(got, -1).end_word, x.end_word),
                  'source_id', element_at(got, -1).source_id, 'source_word', element_at(got, -1).source_word, 'source_ids', array_union(element_at(got, -1).source_ids, x.source_ids)))),
                concat(got, array(x))))"""
    )
    return spans.select("doc_id", "key", F.inline(joined))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the repeated passages in its texts; documents that were nothing else go.

    Where a passage is cut out, what stands before and after it stays as it is. Documents that repeat
    nothing, null and empty texts stay untouched. Columns may have any names. The spans are written first, so that
    the planner knows their size and texts are shuffled to them only where they are too many to broadcast.
    """
    own = spared(docs, "_key", "_spans")
    spans = written(repeated_passages(docs, id_col, text_col).groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("first_word", "end_word")).alias("_spans")))
    marked = own.withColumn("_key", F.xxhash64(F.col(id_col), F.col(text_col))).join(spans, "_key", "left").drop("_key")
    at, spans_at = docs.columns.index(text_col), len(docs.columns)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            data, offsets = text_bytes(texts)
            cut_rows = [i for i, s in enumerate(batch.column(spans_at).is_valid().to_pylist()) if s]
            new = {}
            for i in cut_rows:
                raw = data[offsets[i] : offsets[i + 1]]
                w = find_words(raw, np.array([0, len(raw)]), lower=False)
                keep = np.ones(len(raw), dtype=bool)
                for s in batch.column(spans_at)[i].as_py():
                    end = w.starts[s["end_word"]] if s["end_word"] < len(w.starts) else len(raw)
                    keep[w.starts[s["first_word"]] : end] = False
                new[i] = raw[keep].tobytes().decode() if keep[w.starts].any() else None
            values = texts.to_pylist() if new else None
            gone = [i for i, t in new.items() if t is None]
            for i, t in new.items():
                values[i] = t
            columns = [pa.array(values, texts.type) if k == at and new else batch.column(k) for k in range(len(docs_columns))]
            out = pa.RecordBatch.from_arrays(columns, names=docs_columns)
            if gone:
                mask = np.ones(len(out), dtype=bool)
                mask[gone] = False
                out = out.filter(pa.array(mask))
            yield out

    docs_columns = own.columns
    return marked.select(*own.columns, "_spans").mapInArrow(run, own.schema).toDF(*docs.columns)
