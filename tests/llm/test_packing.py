import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidepanel.llm.packing import TIERS, Document, Packer, pack
from tidepanel.llm.tokens import END_ID, Encoder, default_path

ODD = [
    "", " \n", "The QUICK brown fox, jumps!! over 12 dogs.", "it's we'll don't 'quoted'", "É été ß ÀÖ×÷ÿ naïve é", "日本語 テスト 混ざる abc日", "a<|endoftext|>b <|ENDOFTEXT|>",
    "\x00\x01 ctrl\x1fchar", "²³ ½ ٣ x y z\u0085w", "İstanbul ΣΑΣ ǅ", "|||###%%% $$$ a_b-c/d", "tab\tnew\r\nline\x0bvt\x0cff", "x" * 3000, "ab1c2 3d 44", "👩‍👩‍👧 🙂 ok", "Ⅷ ℌ ﬁ",
]


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return [[*e.ids, END_ID] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def encode(encoder, texts):
    raw = [(t or "").encode() for t in texts]
    ids, bounds = encoder.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_ids_equal_the_tokenizers(spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()][:400]
    encoder = Encoder(default_path())
    want = reference_ids(texts)
    assert encode(encoder, texts) == want
    assert encode(encoder, texts[::-1]) == want[::-1]
    encoder.forget()
    assert encode(encoder, [""]) == [[END_ID]]


@pytest.mark.parametrize("lengths", [[1], [4096], [5000, 1, 1], [600] * 50, list(range(1, 900, 7)), [3000] * 9, []])
def test_windows_are_full_and_hold_each_token_once(lengths):
    packer = Packer()
    for i, n in enumerate(lengths):
        packer.add(Document(i, np.arange(n)))
        if i % 20 == 19:
            packer.pack()
    packer.finish()
    seen = defaultdict(list)
    for size, pieces in (w for group in packer.drain(last=True) for w in group):
        assert sum(p.length for p in pieces) == size and (size in TIERS or size & (size - 1) == 0)
        for p in pieces:
            seen[p.document.id] += range(p.start, p.start + p.length)
    assert all(sorted(seen[i]) == list(range(n)) for i, n in enumerate(lengths))


def test_pieces_rebuild_the_documents(spark):
    texts = [None, *ODD, *["word " * n for n in (10, 700, 5000)]]
    rows = [(None if i == 3 else i, t, i, "x") for i, t in enumerate(texts)] + [(5, texts[5], 5, "x")]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string, offset int, ids string").repartition(3)).collect()
    want = sorted((r[0] if r[0] is not None else -1, x) for r, x in zip(rows, reference_ids([r[1] for r in rows])) if r[0] != 5)
    docs, windows = defaultdict(dict), defaultdict(list)
    for r in out:
        ids = np.frombuffer(r.ids, dtype="<u4")
        assert len(ids) == r.length
        windows[r.sequence_id].append((r.offset, r.length, r.window))
        if r.doc_id != 5:
            docs[-1 if r.doc_id is None else r.doc_id][r.start] = ids
    assert sorted((k, np.concatenate([v[s] for s in sorted(v)]).tolist()) for k, v in docs.items()) == want
    assert sum(r.length for r in out if r.doc_id == 5) == 2 * len(reference_ids([texts[5]])[0])
    for w in windows.values():
        assert sum(x[1] for x in w) == w[0][2] and [x[0] for x in sorted(w)] == [sum(y[1] for y in sorted(w)[:k]) for k in range(len(w))]
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_digest(spark):
    from tidepanel.llm.queries import op10_packing

    out = op10_packing(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = dict(zip(texts, reference_ids(list(texts.values()))))
    assert all(zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) for r in out)
    assert sum(r.length for r in out) == sum(map(len, ids.values()))


def test_step_groups_are_balanced():
    r = np.random.default_rng(0)
    packer, groups = Packer(), []
    for i, n in enumerate(r.integers(1, 3000, 2000)):
        packer.add(Document(i, np.arange(n)))
        if i % 100 == 99:
            packer.pack()
            groups += packer.drain()
    assert all(sum(size for size, _ in g) == 65536 and len({size for size, _ in g}) == 1 for g in groups)
    packer.finish()
    last = [sum(size for size, _ in g) for g in packer.drain(last=True)]
    uneven = [n for n in last if n != 65536]
    assert len(groups) > 20 and len(uneven) <= 4 and max(uneven) <= 65536 + 4096 and max(uneven) - min(uneven) <= 4096
    assert sum(last) + 65536 * len(groups) == sum(r2 for r2 in np.random.default_rng(0).integers(1, 3000, 2000))
    assert list(packer.drain(last=True)) == []


def test_a_long_text_over_many_slices_in_bounded_memory():
    import resource

    text = np.frombuffer(("plain words of some length and 12 more\n" * 30000).encode(), dtype=np.uint8)
    data = np.tile(text, 14)  # 16 MB, one text
    encoder = Encoder(default_path())
    one, _ = encoder.encode(text, np.array([0, len(text)]))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ids, bounds = encoder.encode(data, np.array([0, len(data)]))
    assert len(ids) == bounds[1] == 14 * (len(one) - 1) + 1 and (ids[: len(one) - 1] == one[:-1]).all() and (ids[-len(one) :] == one).all()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100 * len(data) // 1024
