"""Chat formatting by token-level assembly.

Each text is encoded by itself and spliced between reserved ids, so no text can produce a control id; in
the rendered form, control strings inside texts are escaped reversibly. Loss masks come from prefix sums of
the assistant segments' borders. Turns stay rows of their own: a conversation of any length is streamed in
turn order through one task and never held at once.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings in the rendered form; their ids follow the vocabulary in this order.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ANS]", "[ROLE]", "[/ROLE]")
_BOS, _EOS, _INST, _INST_END, _SYS, _SYS_END, _ANS, _ROLE, _ROLE_END = range(len(CONTROL))
_AROUND = {"user": (_INST, _INST_END), "system": (_SYS, _SYS_END), "assistant": (_ANS, _EOS)}
_OPENED = {a: role for role, (a, _) in _AROUND.items()}
_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """A backslash before each backslash and each control string."""
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Codec:
    """Byte-level BPE from a file of ranks; any text decodes to itself."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.first_control = max(ranks.values()) + 2

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per turn: (``conv_id``, ``position``, ``start``, ``ids``, ``loss_mask``).

    A conversation is its rows in order of turn, then role and text (nulls first); ``position`` counts them
    from 0 and ``start`` counts the ids before the turn, so the conversation's ids are the rows' ids one
    after the other. Rows without a conversation form one together. Null texts and roles are empty. Roles
    other than user, assistant and system are written out between markers of their own. ``loss_mask`` is 1
    for the ids of assistant texts. Repeated rows are turns of their own; other columns are ignored; an
    empty table gives no rows. All rows of a conversation pass through one task, sorted on disk if needed.
    """
    path = tokenizer or default_path()
    kind = turns.select(conv_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        first = c.first_control
        now, position, start = object(), 0, 0
        for batch in batches:
            ids: list[int] = []
            bounds, positions, starts, borders = [0], [], [], []
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if conv != now:
                    now, position, start = conv, 0, 0
                    ids.append(first + _BOS)
                if role in _AROUND:
                    opened, closed = _AROUND[role]
                    ids.append(first + opened)
                else:
                    closed = None
                    ids += [first + _ROLE, *c.encode(escape(role or "")), first + _ROLE_END]
                content = c.encode(escape(text or ""))
                if role == "assistant":
                    borders += [len(ids), len(ids) + len(content)]
                ids += content
                if closed is not None:
                    ids.append(first + closed)
                positions.append(position)
                starts.append(start)
                position += 1
                start += len(ids) - bounds[-1]
                bounds.append(len(ids))
            steps = np.zeros(len(ids) + 1, dtype=np.int8)
            np.add.at(steps, borders[::2], 1)
            np.add.at(steps, borders[1::2], -1)
            mask = np.cumsum(steps[:-1], dtype=np.int8)
            at = pa.array(bounds, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(positions, pa.int64()), pa.array(starts, pa.int64()), pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(at, pa.array(mask))],
                names=["conv_id", "position", "start", "ids", "loss_mask"],
            )

    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(run, f"conv_id {kind}, position long, start long, ids array<int>, loss_mask array<tinyint>")


def read_back(formatted: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per conversation, from the ids and masks of :func:`format_turns` alone (in its order of rows).

    (``conv_id``, ``n_turns``, ``turns_sha256`` of role, newline, text, newline for each turn, ``loss_chars``
    and ``loss_sha256`` of the unescaped text under the mask, ``formatted_chars`` of the rendered form).
    """
    path = tokenizer or default_path()
    kind = formatted.select("conv_id").schema[0].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        first = c.first_control
        state: list = []

        def result(rows: list[list], id_type) -> pa.RecordBatch:
            columns = list(zip(*[(r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5]) for r in rows])) or [()] * 6
            kinds = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        id_type = pa.int64()
        for batch in batches:
            id_type, done = batch.column(0).type, []
            for conv, position, ids, mask in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), batch.column(4)):
                if position == 0:
                    done += state
                    state = [[conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]]
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy().astype(bool)
                at = np.flatnonzero(ids >= first)
                marks = [int(i) - first for i in ids[at]]
                spans = [c.decode(ids[a + 1 : b].tolist()) for a, b in zip(at, [*at[1:], len(ids)])]
                role = next((_OPENED[m] for m in marks if m in _OPENED), None)
                if role is None:
                    role = unescape(spans[marks.index(_ROLE)])
                    text = spans[marks.index(_ROLE_END)]
                else:
                    text = spans[next(i for i, m in enumerate(marks) if m in _OPENED)]
                s = state[0]
                s[1] += 1
                s[2].update(f"{role}\n{unescape(text)}\n".encode())
                learnt = unescape(c.decode(ids[mask].tolist()))
                s[3] += len(learnt)
                s[4].update(learnt.encode())
                s[5] += sum(len(CONTROL[m]) for m in marks) + sum(map(len, spans))
            if done:
                yield result(done, id_type)
        if state:
            yield result(state, id_type)

    return formatted.mapInArrow(run, schema)
