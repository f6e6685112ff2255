import re

import numpy as np
import pytest
import xxhash

from tidepanel.llm import simhash
from tidepanel.llm.lineage import components


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for i in range(64):
            counts[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * counts[i] > len(grams))


def slow_components(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_components_of_paths_stars_and_rings(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = slow_components(pairs, {x for p in pairs for x in p})
    assert got == {k: v for k, v in want.items() if k != v}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_golay_decoding_finds_the_only_codeword_in_reach():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    base = words ^ simhash._nearest()[simhash._syndrome(words)]
    assert (simhash._syndrome(base) == 0).all()
    for k in range(3):
        noisy = base.copy()
        for _ in range(k + 1):
            noisy ^= 1 << rng.integers(0, 23, len(base))
        assert (simhash.codeword_index(noisy) == base >> 11).all()


def test_keys_meet_for_every_pair_within_two_bits():
    rng = np.random.default_rng(2)
    fp = rng.integers(-(1 << 63), (1 << 63) - 1, 300)
    flips = [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)]
    stored = simhash.fuzzy_keys(fp[:1])[0][0]
    others = fp[:1].view(np.uint64) ^ np.array(flips, dtype=np.uint64)
    _, rows, keys = simhash.fuzzy_keys(others.view(np.int64))
    assert set(rows[np.isin(keys, stored)].tolist()) == set(range(len(flips)))


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(40):
        base = rng.choice(vocab, rng.integers(1, 300)).tolist()
        texts.append(" ".join(base))
        for _ in range(rng.integers(0, 4)):
            near = list(base)
            near[rng.integers(0, len(near))] = "other"
            texts.append("\n ".join(near).upper())
    texts += [None, "", " \t\n", "One", "one two", "ein  \x0bzwei drei vier", "é É ü", "x" * 5, texts[0], texts[0], "long " * 40000]
    rows = [(i * 3 + 1, t, "extra") for i, t in enumerate(texts)]
    prints = {i: slow_fingerprint(t) for i, t, _ in rows}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    want = slow_components(pairs, prints)
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (prints[i], want[i]) for i in prints}
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted(kept) == sorted(set(want.values()))


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, None), (7, "a b c d"), (7, "a b c d"), (9, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 7), (0, 9), (7, 7), (7, 7), (9, 9)]
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [7, 9]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 40000])
def test_fingerprint_of_short_and_long_texts(n):
    text = " ".join(f"t{i % 977}" for i in range(n))
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    assert simhash.fingerprints(data, np.array([0, len(data)]))[0] == slow_fingerprint(text)


def test_keep_one_with_odd_rows_and_names(spark):
    rows = [(2, "a b c d", 1, 2), (1, "a b c d", 1, 2), (1, "a b c d", 1, 2), (1, "other words here now", 1, 2), (7, None, 1, 2), (8, "", 1, 2), (None, " ", 1, 2), (None, "alone in the world", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept int, _COPY int")
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id or 0, r.text or "") for r in out.collect()))
    assert got == [(0, "alone in the world"), (1, "a b c d"), (1, "other words here now"), (7, "")]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_query(spark):
    from tidepanel.llm.queries import op8_simhash_golay

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    want = slow_components(near, prints)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in op8_simhash_golay(spark, d).collect()} == {(i, f"{p:016x}", want[i]) for i, p in prints.items()}
