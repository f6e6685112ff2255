"""Hierarchical multi-length packing of token sequences.

A document's whole windows of the longest context are cut off first; its rest goes to the shortest tier
(window length) that holds it. Tiers are packed from the longest down: each window takes the longest rest
of its tier, fills the gap with the longest rests that fit, from shorter tiers too, and at last with a cut
of a short rest, whose remainder is routed anew. So windows are full. What is left at a partition's end,
less than one window, becomes windows of the powers of two in its length.

Windows of one length form step groups of 65,536 tokens, carried from block to block until a group is full. What is
left at a partition's end is dealt to as few groups as hold it, each window to the one with the fewest tokens so far, so
these differ by one window at most.

Each input partition is packed where it is read: nothing is shuffled, memory is bounded by a block of
tokens and one document, and a lost task is packed again by itself with the same result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.tokens import default_path, encode_texts
from tidepanel.llm.words import lean, text_bytes

TIERS = (512, 1024, 2048, 4096)
STEP = 1 << 16
BLOCK = 1 << 20


@dataclass(slots=True, eq=False)
class Document:
    id: object
    ids: np.ndarray


@dataclass(slots=True, eq=False)
class Piece:
    document: Document
    start: int
    length: int


class Packer:
    """Packs documents into windows; ``windows`` holds (length, pieces) that are done."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers))
        self.pools: list[list] = [[] for _ in self.tiers]  # sorted (length, serial, piece)
        self.windows: list[tuple[int, list[Piece]]] = []
        self.serial = 0

    def add(self, document: Document) -> None:
        top, n = self.tiers[-1], len(document.ids)
        for at in range(0, n - top + 1, top):
            self.windows.append((top, [Piece(document, at, top)]))
        if n % top:
            self._route(Piece(document, n - n % top, n % top))

    def _route(self, piece: Piece) -> None:
        self.serial += 1
        insort(self.pools[bisect_left(self.tiers, piece.length)], (piece.length, self.serial, piece))

    def _fitting(self, gap: int, tier: int) -> Piece | None:
        for pool in reversed(self.pools[: min(tier, bisect_left(self.tiers, gap)) + 1]):
            if at := bisect_right(pool, (gap, 1 << 62)):
                return pool.pop(at - 1)[2]
        return None

    def _cut(self, gap: int, tier: int) -> Piece | None:
        for pool in self.pools[: tier + 1]:
            if pool:
                piece = pool.pop()[2]
                self._route(Piece(piece.document, piece.start + gap, piece.length - gap))
                return Piece(piece.document, piece.start, gap)
        return None

    def pack(self) -> None:
        """Fills windows with all that is routed; less than one window stays."""
        rest: list[Piece] = []
        for tier in reversed(range(len(self.tiers))):
            while self.pools[tier]:
                window = [self.pools[tier].pop()[2]]
                gap = self.tiers[tier] - window[0].length
                while gap and (piece := self._fitting(gap, tier) or self._cut(gap, tier)):
                    window.append(piece)
                    gap -= piece.length
                if gap:
                    rest += window
                else:
                    self.windows.append((self.tiers[tier], window))
        for piece in rest:
            self._route(piece)

    def finish(self) -> None:
        self.pack()
        rest = [x[2] for pool in self.pools for x in pool]
        self.pools = [[] for _ in self.tiers]
        left = sum(p.length for p in rest)
        while left:
            size = 1 << (left.bit_length() - 1)
            window, gap = [], size
            while gap:
                piece = rest.pop()
                if piece.length > gap:
                    rest.append(Piece(piece.document, piece.start + gap, piece.length - gap))
                    piece = Piece(piece.document, piece.start, gap)
                window.append(piece)
                gap -= piece.length
            self.windows.append((size, window))
            left -= size

    def drain(self, step: int = STEP, last: bool = False) -> Iterator[list[tuple[int, list[Piece]]]]:
        """Step groups: those that are full, and with ``last`` what is left in groups of about equal token counts."""
        by_length: dict[int, list] = {}
        for window in self.windows:
            by_length.setdefault(window[0], []).append(window)
        self.windows = []
        for size in sorted(by_length, reverse=True):
            windows, full = by_length[size], max(1, step // size)
            while len(windows) >= full:
                yield windows[:full]
                del windows[:full]
            self.windows += windows
        if last and self.windows:
            groups: list[list] = [[] for _ in range(-(-sum(w[0] for w in self.windows) // step))]
            loads = [(0, k) for k in range(len(groups))]
            for window in self.windows:  # longest first
                load, k = heapq.heappop(loads)
                groups[k].append(window)
                heapq.heappush(loads, (load + window[0], k))
            self.windows = []
            yield from groups


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece: (``id_col``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``, ``window``, ``step_group``, ``ids``).

    ``ids`` holds the piece's token ids as little-endian 32-bit integers. ``start`` counts the document's
    ids before the piece, ``offset`` those before it in its sequence, ``window`` is the sequence's length.
    Each row of ``docs`` is a document (repeated rows too); its ids end with id 2, so null, empty and blank
    texts have that one id. Null ids are kept; an empty table gives no rows; other columns are ignored.
    ``tokenizer`` is a file of a tokenizer whose pre-tokeniser cuts at white space, present on all workers.
    """
    path = tokenizer or default_path()
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def rows(group, state, id_type) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(9)]
        for size, pieces in group:
            at = 0
            for p in pieces:
                ids = p.document.ids[p.start : p.start + p.length]
                for column, value in zip(out, (p.document.id, p.start, p.length, len(p.document.ids), state["next"], at, size, state["group"], ids.astype("<u4").tobytes())):
                    column.append(value)
                at += p.length
            state["next"] += 1
        state["group"] += 1
        kinds = (id_type, *[pa.int64()] * 7, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "window", "step_group", "ids"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        state, packer, pending, id_type = {"next": base, "group": base}, Packer(tiers), 0, pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            names = batch.column(0).to_pylist()
            data, offsets = text_bytes(batch.column(1))
            for first, ids, bounds in encode_texts(path, data, offsets):
                for k in range(len(bounds) - 1):
                    packer.add(Document(names[first + k], ids[bounds[k] : bounds[k + 1]]))
                pending += len(ids)
                if pending >= BLOCK:
                    packer.pack()
                    for group in packer.drain():
                        yield rows(group, state, id_type)
                    pending = 0
        packer.finish()
        for group in packer.drain(last=True):
            yield rows(group, state, id_type)

    out = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, window long, step_group long, ids binary")
    return out.withColumnRenamed("id", id_col)
