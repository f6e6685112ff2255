"""Token ids of whole texts through a public tokenizer file, each distinct piece of text encoded once.

Texts are cut at white space, where this tokenizer's normaliser and pre-tokeniser always cut, and further
where a run of letters, a digit or a run of other ASCII characters ends. Words with anything less plain
(apostrophes, ``<``, control characters, letters beyond Latin-1) stay whole and are encoded as they are, so
the ids equal those of the tokenizer over the whole text. A worker remembers the pieces it has met, up to
a bound.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from tidepanel.llm.words import LOWER, SLICE, SPACE, chunks, find_words, span_hashes

END_ID = 2
REMEMBERED = 1 << 19  # pieces: some 25 MB

_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[SPACE] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[*range(9), *range(14, 32), 127, *range(128, 256), ord("'"), ord("<")]] = _ODD


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """ids of texts, with ``END_ID`` after each."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            ends[i] = token.endswith("</w>")
        self.ends = ends
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes of pieces, and where their ids lie
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids (uint32) of the texts one after the other, and the bounds of each text's ids."""
        raw, plain, starts, ends, bounds = self._pieces(data, offsets)
        hashes = span_hashes(raw, starts, ends)
        distinct, first, piece = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > REMEMBERED:
            self.forget()
        place = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != distinct[inside]
        if new.any():
            self._learn(distinct[new], raw, starts[first[new]], ends[first[new]], plain[first[new]])
            place = np.searchsorted(self.known, distinct)
        size = np.append(self.size[place], 1)[np.insert(piece, bounds[1:], len(distinct))]
        at = np.append(self.at[place], -1)[np.insert(piece, bounds[1:], len(distinct))]
        reach = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(at - reach[:-1], size) + np.arange(reach[-1])
        out_bounds = reach[bounds + np.arange(len(bounds))]
        where[out_bounds[1:] - 1] = 0
        ids = self.flat[where] if len(self.flat) else np.zeros(len(where), np.uint32)
        ids[out_bounds[1:] - 1] = END_ID
        return ids, out_bounds

    def _pieces(self, data, offsets):
        w = find_words(data, offsets, lower=False)
        kind = _KIND[data]
        if (data > 127).any():
            lead = np.flatnonzero(data[:-1] == 0xC3)
            second = data[lead + 1]
            lead = lead[(second >= 0x80) & (second != 0x97) & (second != 0xB7)]
            kind[lead] = kind[lead + 1] = _LETTER
        odd = np.concatenate([[0], np.cumsum(kind == _ODD)])
        odd_word = odd[w.ends] > odd[w.starts]
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        inside[w.starts[odd_word]] += 1
        np.subtract.at(inside, w.ends[odd_word], 1)
        whole = np.cumsum(inside[:-1]) > 0
        raw = np.where(whole, data, LOWER[data])
        upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (kind[:-1] == _LETTER) & ~whole[:-1])
        raw[upper + 1] += 0x20
        begin = np.zeros(len(data), dtype=bool)
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        begin &= ~whole & (kind != _SPACE)
        begin[w.starts] = True
        starts = np.flatnonzero(begin)
        last = np.zeros(len(data) + 1, dtype=bool)
        last[starts] = True
        last[w.ends] = True
        stops = np.flatnonzero(last)
        ends = stops[np.searchsorted(stops, starts, side="right")] if len(starts) else starts
        return raw, ~whole[starts], starts, ends, np.searchsorted(starts, offsets)

    def _learn(self, hashes, raw, starts, ends, plain) -> None:
        text = raw.tobytes()
        pieces = [text[s:e].decode("utf-8", "replace") for s, e in zip(starts.tolist(), ends.tolist())]
        size = np.zeros(len(pieces), np.int64)
        rows: list[np.ndarray] = []
        order: list[np.ndarray] = []
        easy = np.flatnonzero(plain)
        for a in range(0, len(easy), 4096):
            block = easy[a : a + 4096]
            ids = np.array(self.tokenizer.encode(" ".join([pieces[i] for i in block]), add_special_tokens=False).ids, dtype=np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(block) or stops[-1] != len(ids):
                plain[block] = False
                continue
            size[block] = np.diff(stops, prepend=0)
            rows.append(ids)
            order.append(block)
        hard = np.flatnonzero(~plain)
        for i, e in zip(hard.tolist(), self.tokenizer.encode_batch([pieces[i] for i in hard], add_special_tokens=False)):
            size[i] = len(e.ids)
            rows.append(np.array(e.ids, dtype=np.uint32))
        order.append(hard)
        order = np.concatenate(order)
        at = np.zeros(len(pieces), np.int64)
        at[order] = len(self.flat) + np.concatenate([[0], np.cumsum(size[order])[:-1]])
        self.flat = np.concatenate([self.flat, *rows])
        known = np.concatenate([self.known, hashes])
        by = np.argsort(known, kind="stable")
        self.known, self.at, self.size = known[by], np.concatenate([self.at, at])[by], np.concatenate([self.size, size])[by]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    return Encoder(path)


def encode_texts(path: str, data: np.ndarray, offsets: np.ndarray, most: int = SLICE):
    """For slices of the rows: first row, ids, bounds of the rows' ids."""
    for a, b in chunks(offsets, most):
        ids, bounds = encoder(path).encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, ids, bounds
