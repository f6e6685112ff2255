"""Language-model scoring with a weighted backoff automaton.

All n-grams of the training rows up to order three are counted and smoothed, each by its context's shorter
one: p(w | t u) = (c(t u w) + PRIOR p(w | u)) / (c(t u) + PRIOR). A state is a context of none, one or two
words, an arc a seen word with its log-probability there, and each state has a failure arc that weighs
PRIOR / (c + PRIOR). A text is scored in one traversal from left to right that carries the state.

The automaton of a corpus grows with it, so no worker holds it whole. Texts are grouped into parts of bounded
size. A part sends the keys of its distinct n-grams, in sorted blobs by ranges of the key space; each range
adds up the parts' counts and answers every part in its order. With these counts over the whole corpus a part
builds exactly the states and arcs that its own texts can reach, which gives the same scores as the whole
automaton. Nothing is pruned, capped or broadcast: the number of parts and of ranges follows the corpus.
Keys are 56-bit hashes. Words the training rows lack share one unknown word's probability, as in the base score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.words import chunks, find_words, mix, span_hashes, text_bytes

PART = 5 << 20  # bytes of text, but for a single longer one
RANGE = 1 << 22  # n-grams, repeats included, of a range of keys
DISCOUNT = 0.75  # of words, if it can't be estimated
PRIORS = (0.0, 300.0, 10.0)  # weight of the shorter context, by the context's length; chosen on a split of training rows
SEGMENT = 2048  # tokens; longer texts move on in segments, each entered in its true state
END = np.uint64(0x5851F42D4C957F2D)  # stands for the end of a text
_KEY_BITS = 56

def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, and the bounds of the texts."""
    w = find_words(data, offsets)
    bounds = w.bounds + np.arange(len(w.bounds))
    out = np.full(bounds[-1], END, dtype=np.uint64)
    out[np.arange(len(w.starts)) + w.doc_of()] = span_hashes(w.data, w.starts, w.ends)
    return out, bounds


class Counter:
    """Sums of keys, merged as they come; emptied once they are many."""

    def __init__(self, most: int = 1 << 21):
        self.most, self.keys, self.counts, self.parts, self.waiting = most, np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.parts.append((k, c))
        self.waiting += len(k)
        if self.waiting > max(len(self.keys), 1 << 19):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.parts)])
        counts = np.concatenate([self.counts, *(c for _, c in self.parts)])
        self.keys, where = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(where, weights=counts, minlength=len(self.keys)).astype(np.int64)
        self.parts, self.waiting = [], 0

    def take(self, force: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if force:
            self.merge()
        if len(self.keys) > self.most or force:
            yield self.keys, self.counts
            self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)


@dataclass
class Corpus:
    """What all scores need of the training words."""

    total: int  # tokens
    distinct: int
    discount: float

    def log_word(self, counts: np.ndarray) -> np.ndarray:
        """Log-probabilities of words by their counts; a count of zero is the unknown word."""
        if not self.total:
            return np.zeros(len(counts))
        return np.log10(np.where(counts > 0, counts - self.discount, max(self.discount * self.distinct, 1e-9)) / self.total)

    def log_base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10(counts + 1.0) - np.log10(self.total + self.distinct + 1)


def train(texts: DataFrame, bits: int) -> Corpus:
    """Totals over the words of ``texts`` (one column); each word's count is exact."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in chunks(offsets):
                counter.add(_word_keys(tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[0]))
                for keys, counts in counter.take():
                    yield from _blobs(keys, counts, bits, 0).to_batches()
        for keys, counts in counter.take(force=True):
            yield from _blobs(keys, counts, bits, 0).to_batches()

    def total(table: pa.Table) -> pa.Table:
        _, counts, _, _ = _summed(table)
        return pa.table({"n": [counts.sum()], "kinds": [len(counts)], "singles": [(counts == 1).sum()], "doubles": [(counts == 2).sum()]})

    sums = texts.mapInArrow(count, _ASKED).groupBy("range_id").applyInArrow(total, "n long, kinds long, singles long, doubles long")
    n, kinds, singles, doubles = (int(v or 0) for v in sums.agg(F.sum("n"), F.sum("kinds"), F.sum("singles"), F.sum("doubles")).first())
    return Corpus(n, kinds, singles / (singles + 2 * doubles) if singles and doubles else DISCOUNT)


def _word_keys(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes, 1) >> np.uint64(64 - _KEY_BITS)


def _longer_keys(heads: np.ndarray, words: np.ndarray, order: int) -> np.ndarray:
    """Keys of n-grams by those of all but their last words."""
    with np.errstate(over="ignore"):
        return mix(heads * np.uint64(0xD1342543DE82EF95) + words, order + 1) >> np.uint64(64 - _KEY_BITS)


def _all_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    hashes, bounds = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for a, b in chunks(offsets):
        h, at = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        hashes.append(h)
        bounds.append(at[1:] + bounds[-1][-1])
    return np.concatenate(hashes), np.concatenate(bounds)


@dataclass
class Grams:
    """The distinct n-grams of some texts, by order (0: words), and which one ends at each token."""

    bounds: np.ndarray
    kinds: list[np.ndarray]  # key of each distinct n-gram
    at: list[np.ndarray]  # number of the n-gram that ends at a token, -1 where there is none
    heads: list[np.ndarray]  # for pairs the first word, for triples the first pair
    tails: list[np.ndarray]  # the last word

    def keys(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """All keys, sorted and distinct, and the places of each order's among them."""
        every, where = np.unique(np.concatenate(self.kinds), return_inverse=True)
        return every, np.split(where, np.cumsum([len(k) for k in self.kinds])[:-1])


def grams(column: pa.Array) -> Grams:
    """N-grams of whole texts; the end stands before the first word too, alone."""
    h, bounds = _all_tokens(column)
    words, number = np.unique(h, return_inverse=True)
    first = np.zeros(len(h), dtype=bool)
    first[bounds[:-1]] = True
    before = np.roll(number, 1)
    before[first] = np.searchsorted(words, END)
    pairs, pair = np.unique(before * len(words) + number, return_inverse=True)
    inside = np.flatnonzero(~first)
    triples, which = np.unique(pair[inside - 1] * len(words) + number[inside], return_inverse=True)
    triple = np.full(len(h), -1)
    triple[inside] = which
    heads, tails = [np.zeros(0, np.int64)], [np.arange(len(words))]
    kinds = [_word_keys(words)]
    for longer in (pairs, triples):
        heads.append(longer // max(len(words), 1))
        tails.append(longer % max(len(words), 1))
        kinds.append(_longer_keys(kinds[-1][heads[-1]], words[tails[-1]], len(kinds)))
    return Grams(bounds, kinds, [number, pair, triple], heads, tails)


@dataclass
class Automaton:
    """States 0 (root), then words seen before others, then pairs; arcs sorted by ``state * words + word``."""

    words: int
    logp: np.ndarray  # of words in the root
    home: np.ndarray  # the state that a word alone leads to
    arcs: np.ndarray
    arc_logp: np.ndarray
    arc_next: np.ndarray
    fail: np.ndarray
    fail_logp: np.ndarray

    def traverse(self, numbers: np.ndarray, bounds: np.ndarray, end: int) -> np.ndarray:
        """Sums of log10 probabilities per text; the texts move in step."""
        size = np.diff(bounds)
        parts = np.maximum(-(-size // SEGMENT), 1)
        doc = np.repeat(np.arange(len(size)), parts)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = bounds[doc] + nth * SEGMENT
        length = np.minimum(bounds[doc + 1] - begin, SEGMENT)
        order = np.argsort(-length, kind="stable")
        doc, nth, begin, length = doc[order], nth[order], begin[order], length[order]
        state = np.full(len(doc), self.home[end])
        rows = np.flatnonzero(nth > 0)
        state[rows] = 0
        for back in (2, 1):  # the state depends on the last two words alone
            state[rows], _ = self._step(state[rows], numbers[begin[rows] - back])
        out = np.zeros(len(doc))
        active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
        for t, n in enumerate(active.tolist()):
            state[:n], logp = self._step(state[:n], numbers[begin[:n] + t])
            out[:n] += logp
        return np.bincount(doc, weights=out, minlength=len(size))

    def _step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        logp, after = self.logp[word], self.home[word]
        rows = np.flatnonzero(state)
        at_state, spent = state[rows], np.zeros(len(rows))
        while len(rows):
            key = at_state * self.words + word[rows]
            at = np.searchsorted(self.arcs, key)
            at[at == len(self.arcs)] = 0
            hit = self.arcs[at] == key
            logp[rows[hit]] = spent[hit] + self.arc_logp[at[hit]]
            after[rows[hit]] = self.arc_next[at[hit]]
            rows, spent, at_state = rows[~hit], spent[~hit] + self.fail_logp[at_state[~hit]], self.fail[at_state[~hit]]
            ended = at_state == 0
            logp[rows[ended]] += spent[ended]
            rows, spent, at_state = rows[~ended], spent[~ended], at_state[~ended]
        return after, logp


def build(g: Grams, counts: list[np.ndarray], corpus: Corpus) -> Automaton:
    """The states and arcs that the texts of ``g`` can reach, from the corpus-wide counts of their n-grams."""
    one, two, three = counts
    logp = corpus.log_word(one)
    left1, left2 = PRIORS[1] / (one + PRIORS[1]), PRIORS[2] / (two + PRIORS[2])
    p2 = two / (one[g.heads[1]] + PRIORS[1]) + left1[g.heads[1]] * 10 ** logp[g.tails[1]]
    seen2, seen3 = np.flatnonzero(two > 0), np.flatnonzero(three > 0)
    ones = np.flatnonzero(one > 0)
    home = np.zeros(len(one), np.int64)
    home[ones] = 1 + np.arange(len(ones))
    state = home[g.tails[1]]
    state[seen2] = 1 + len(ones) + np.arange(len(seen2))
    width = max(len(one), 1)
    pair_keys = g.heads[1] * width + g.tails[1]  # sorted, as pairs are numbered
    inner = np.searchsorted(pair_keys, g.tails[1][g.heads[2][seen3]] * width + g.tails[2][seen3])
    base = g.heads[2][seen3]
    p3 = three[seen3] / (two[base] + PRIORS[2]) + left2[base] * p2[inner]
    arcs = np.concatenate([home[g.heads[1][seen2]] * width + g.tails[1][seen2], state[base] * width + g.tails[2][seen3]])
    arc_logp, after = np.log10(np.concatenate([p2[seen2], p3])), np.concatenate([state[seen2], state[inner]])
    if not len(arcs):
        arcs, arc_logp, after = np.array([-1]), np.zeros(1), np.zeros(1, np.int64)
    order = np.argsort(arcs)
    fail = np.concatenate([np.zeros(1 + len(ones), np.int64), home[g.tails[1][seen2]]])
    fail_logp = np.log10(np.concatenate([[1.0], left1[ones], left2[seen2]]))
    return Automaton(width, logp, home, arcs[order], arc_logp[order], after[order], fail, fail_logp)


def _planes(values: np.ndarray) -> bytes:
    """Non-negative integers, compressed by the place of their bytes: the high ones are mostly zero."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _from_planes(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences: their low halves plain, since they are noise, the high ones compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return steps.astype("<u4").tobytes() + _planes(steps >> np.uint64(32))


def _unpack_keys(blob: bytes, n: int) -> np.ndarray:
    low = np.frombuffer(blob, "<u4", count=n).astype(np.uint64)
    return np.cumsum((_from_planes(blob[4 * n :], n).astype(np.uint64) << np.uint64(32)) | low, dtype=np.uint64)


_ASKED = "range_id long, part long, n long, keys binary, counts binary"
_TOLD = "range_id long, part long, n long, counts binary"


def _blobs(keys: np.ndarray, counts: np.ndarray, bits: int, part: int) -> pa.Table:
    """Sorted distinct keys and their counts, cut where the first ``bits`` bits change."""
    ranges = (keys >> np.uint64(_KEY_BITS - bits)).astype(np.int64)
    cuts = np.append(np.flatnonzero(np.diff(ranges, prepend=-1)), len(keys)).tolist()
    low = keys & np.uint64((1 << (_KEY_BITS - bits)) - 1)
    spans = list(zip(cuts[:-1], cuts[1:]))
    return pa.table(
        {
            "range_id": pa.array([int(ranges[a]) for a, _ in spans], pa.int64()),
            "part": pa.array([part] * len(spans), pa.int64()),
            "n": pa.array([b - a for a, b in spans], pa.int64()),
            "keys": pa.array([_pack_keys(low[a:b]) for a, b in spans], pa.binary()),
            "counts": pa.array([_planes(counts[a:b]) for a, b in spans], pa.binary()),
        }
    )


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Of a range's blobs: distinct keys, their sums, the place of each blob's keys among them, the blobs' sizes."""
    sizes = table.column("n").to_pylist()
    keys = np.concatenate([_unpack_keys(b.as_py(), n) for b, n in zip(table.column("keys"), sizes)])
    own = np.concatenate([_from_planes(b.as_py(), n) for b, n in zip(table.column("counts"), sizes)])
    kinds, where = np.unique(keys, return_inverse=True)
    sums = np.bincount(where, weights=own, minlength=len(kinds)).astype(np.int64)  # exact below 2^53
    return kinds, sums, where, sizes


def _slices(size: int):
    """Rows as (``part``, ``rows``): compressed runs of rows, those of a part holding up to ``size`` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, room = TaskContext.get().partitionId() << 32, size
        for batch in batches:
            offsets = text_bytes(batch.column(1))[1]
            at = 0
            while at < len(batch):
                to = int(np.searchsorted(offsets, offsets[at] + room, side="right")) - 1
                if to <= at:
                    to = at + 1
                    if room < size:
                        part, room = part + 1, size
                        continue
                to = min(to, len(batch))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch.slice(at, to - at))
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part", "rows"])
                room -= int(offsets[to] - offsets[at]) + to - at
                at = to
                if room <= 0:
                    part, room = part + 1, size

    return run


def _opened(table: pa.Table) -> pa.Table:
    """The rows of a part; its runs in a stable order."""
    runs = sorted(r.as_py() for r in table.column("rows"))
    return pa.concat_tables([pa.ipc.open_stream(r).read_all() for r in runs]).combine_chunks()


def _ask(bits: int):
    """Of a part: the keys of its distinct n-grams and their counts in its training rows, by range."""

    def run(table: pa.Table) -> pa.Table:
        rows = _opened(table)
        h, bounds = _all_tokens(rows.column("text").combine_chunks())
        first = np.zeros(len(h), dtype=bool)
        first[bounds[:-1]] = True
        trains = np.repeat(rows.column("trains").to_numpy(), np.diff(bounds)).astype(np.uint64)
        words = _word_keys(h)
        before = np.roll(words, 1)
        before[first] = _word_keys(np.array([END]))[0]
        pairs = _longer_keys(before, h, 1)
        inside = np.flatnonzero(~first)
        triples = _longer_keys(pairs[inside - 1], h[inside], 2)
        every = np.concatenate([(k << np.uint64(1)) | t for k, t in ((words, trains), (pairs, trains), (triples, trains[inside]))])
        every.sort()
        keys = every >> np.uint64(1)
        starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        return _blobs(keys[starts], np.add.reduceat((every & np.uint64(1)).astype(np.int64), starts), bits, table.column("part")[0].as_py())

    return run


def _tell(table: pa.Table) -> pa.Table:
    """Of a range: every part's keys with their counts over all parts, in the part's order."""
    _, sums, where, sizes = _summed(table)
    told = [_planes(t) for t in np.split(sums[where], np.cumsum(sizes)[:-1])]
    return pa.table({"range_id": table.column("range_id"), "part": table.column("part"), "n": table.column("n"), "counts": pa.array(told, pa.binary())})


def _scores(corpus: Corpus):
    """Of a part: the scores of its texts, by the automaton made of the counts it was told."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        rows = _opened(table)
        g = grams(rows.column("text").combine_chunks())
        keys, places = g.keys()
        told = told.sort_by("range_id")
        every = np.concatenate([_from_planes(b.as_py(), n.as_py()) for b, n in zip(told.column("counts"), told.column("n"))])
        if len(every) != len(keys):
            raise RuntimeError("a part's texts changed between its two reads")
        counts = [every[p] for p in places]
        del keys, places, every
        number = g.at[0]
        end = int(number[g.bounds[1] - 1])
        doc = np.repeat(np.arange(len(g.bounds) - 1), np.diff(g.bounds))
        sums = [np.bincount(doc, weights=w[number], minlength=len(rows)) for w in (counts[0] > 0, corpus.log_base(counts[0]))]
        score = build(g, counts, corpus).traverse(number, g.bounds, end)
        return pa.table({"id": rows.column("id"), "n_tokens": np.diff(g.bounds), "n_known": sums[0].astype(np.int64), "base_score": sums[1], "score": score})

    return run


def score_all(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", part: int = PART, span: int = RANGE) -> tuple[DataFrame, Corpus]:
    """(``id_col``, ``n_tokens``, ``n_known``, ``base_score``, ``score``) for every row, and the training totals.

    The model learns from the rows where ``held_out`` isn't true. ``base_score`` sums log10((c + 1) / (N + V + 1));
    ``score`` is the automaton's log10 probability of the text's words and its end. Null texts are empty: they
    score the end alone. Null and repeated ids keep their rows; other columns are ignored; without training rows
    only unknown words remain, whose probability is then taken as one. An empty table gives no rows.

    Parts are runs of the input, so copies and hot sources make no large group; both reads of a part share one
    shuffle. ``docs`` must list its rows in a stable order, as files do.
    """
    trains = ~F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), trains.alias("trains"))
    size = int(rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0)
    bits = max(1, int(np.ceil(np.log2(max(2, size // 2 / span)))))  # about six bytes a token, three n-grams each
    corpus = train(rows.where("trains").select("text"), bits)
    kind, tasks = rows.schema["id"].dataType.simpleString(), max(1, -(-size // part))
    rows = rows.mapInArrow(_slices(part), "part long, rows binary").repartition(tasks, "part")
    told = rows.groupBy("part").applyInArrow(_ask(bits), _ASKED).groupBy("range_id").applyInArrow(_tell, _TOLD).repartition(tasks, "part")
    out = rows.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(_scores(corpus), f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.withColumnRenamed("id", id_col), corpus
