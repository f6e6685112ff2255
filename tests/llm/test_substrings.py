import re
from collections import defaultdict

import numpy as np
import pytest

from tidepanel.llm import substrings as sub


def slow_windows(keys, bounds, width):
    out = []

    def node(lo, hi):
        if hi - lo + 1 < width:
            return
        c = min(range(lo, hi + 1), key=lambda i: (int(keys[i]) >> 22, i))
        out.append((lo, c, hi))
        node(lo, c - 1)
        node(c + 1, hi)

    for a, b in zip(bounds, bounds[1:]):
        node(a, b - 1)
    return sorted((max(lo, c - width + 1), c, min(hi, c + width - 1)) for lo, c, hi in out)


@pytest.mark.parametrize("width", [1, 2, 7, 46])
def test_compact_windows_are_the_wide_nodes_of_the_cartesian_tree(width):
    r = np.random.default_rng(width)
    bounds = np.array([0, 0, 5, 60, 106, 400, 1000])
    keys = r.integers(0, 1 << 63, 1000).astype(np.uint64)
    keys[200:300] = keys[100:200]
    got = sorted(zip(*(x.tolist() for x in sub.compact_windows(keys, bounds, width))))
    assert got == slow_windows(keys, bounds, width)


def words(r, n, tag="w"):
    return [f"{tag}{i}" for i in r.integers(0, 5000, n)]


def test_planted_passages_are_found_and_clean_documents_left(spark):
    r = np.random.default_rng(1)
    passages = [words(r, n, "p") for n in (51, 60, 130, 400)]
    rows, holds = [], defaultdict(set)
    for i in range(160):
        text = words(r, int(r.integers(0, 600)))
        if i % 4 == 0:
            k = i // 4 % 4
            at = int(r.integers(0, len(text) + 1))
            text[at:at] = passages[k]
            holds[k].add(i)
        rows.append((i, "\n".join(text) if i % 3 else " ".join(text).upper(), 1))
    near = rows[2][1].split()
    near[len(near) // 2] = "changed"
    rows += [(200, rows[1][1], 1), (201, " ".join(near), 1), (None, rows[3][1], 1), (4, rows[4][1], 1), (300, None, 1), (301, "", 1), (302, "short text " * 20, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(4)
    out = sub.repeated_passages(docs).collect()
    by = defaultdict(list)
    for x in out:
        assert x.end_word - x.first_word >= sub.WORDS and x.source_ids[0] == x.source_id
        by[x.doc_id].append(x)
    text_of = {i: re.findall(r"\S+", (t or "").lower()) for i, t, _ in rows}
    for k, ids in holds.items():
        marked = {i for i in ids if any(passages[k][j : j + 50] == text_of[i][x.first_word : x.first_word + 50] for x in by[i] for j in range(len(passages[k]) - 49))}
        assert len(marked) >= len(ids) - 1
        for i in marked:
            assert sum(x.end_word - x.first_word for x in by[i]) >= len(passages[k])
    many = {i for ids in holds.values() for i in ids}
    pairs = [{1, 200}, {2, 201}, {3, None}]
    assert set(by) <= many.union(*pairs)
    for a in pairs:
        n = min(len(text_of[i]) for i in a)
        assert n < 50 or any(sum(x.end_word - x.first_word for x in by.get(i, [])) >= 0.9 * n for i in a)
    cleaned = sub.without_repeats(docs)
    assert cleaned.columns == docs.columns
    left = {x.doc_id: x.text for x in cleaned.collect()}
    for i, t, _ in rows:
        if i not in many | {1, 2, 3, 200, 201, None}:
            assert left[i] == t
    for k, ids in holds.items():
        joined = " ".join(passages[k])
        assert sum(joined in " ".join((left.get(i) or "").lower().split()) for i in ids) == 1


def test_a_passage_that_a_third_of_the_rows_share(spark):
    r = np.random.default_rng(2)
    passage = " ".join(words(r, 80, "hot"))
    rows = [(i, " ".join(words(r, 120)) + (" " + passage if i % 3 == 0 else "")) for i in range(300)]
    out = sub.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({x.doc_id for x in out}) == 99 and all(x.doc_id % 3 == 0 and x.source_id % 3 == 0 for x in out)


def test_all_sources_of_a_joined_passage_are_named(spark):
    r = np.random.default_rng(6)
    a, c = words(r, 120), words(r, 120)
    mixed = " ".join(a[:100] + c[20:])
    rows = [(i, t) for i, t in enumerate((" ".join(a), " ".join(c), mixed))]
    out = sub.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {frozenset({x.doc_id, s}) for x in out for s in x.source_ids} == {frozenset({0, 2}), frozenset({1, 2})}


def test_a_passage_is_found_though_an_earlier_document_has_a_part_of_it(spark):
    r = np.random.default_rng(7)
    part, n = words(r, 40, "part"), 60
    rows = []
    for i in range(n):  # two documents share each passage, all have its 40 words
        passage = words(r, 8) + part + words(r, 7)
        rows += [(2 * i + k, " ".join(words(r, 100) + passage + words(r, 100))) for k in (0, 1)]
    out = sub.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    got = {x.doc_id // 2 for x in out if x.first_word <= 100 and x.end_word >= 155}
    assert all(x.doc_id // 2 == s // 2 for x in out for s in x.source_ids)
    assert len(got) == n


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sub.repeated_passages(docs).count() == 0 and sub.without_repeats(docs).count() == 0


def test_shared_passages_tolerate_changes_up_to_the_threshold():
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 60, 200).astype(np.uint64)
    b = a[50:150].copy()
    assert sub.shared_passages(a, b) == [(50, 150, 0)]
    b[40:45] = 1
    assert sub.shared_passages(a, b) == [(50, 150, 0)]
    b[10:90] = np.arange(80, dtype=np.uint64)
    assert sub.shared_passages(a, b) == []


def test_shared_passages_with_a_line_that_stands_earlier_in_the_source_too():
    r = np.random.default_rng(4)
    b = r.integers(0, 1 << 60, 250).astype(np.uint64)
    b[20:26] = b[160:166]
    a = b[150:206].copy()
    a[26:31] = np.arange(5)  # one changed word
    assert sub.shared_passages(a, b) == [(0, 56, 150)]


def slow_spans(one, other):
    """Words of ``one`` that lie in a run of 50 words which ``other`` has."""
    runs = {tuple(other[i : i + 50]) for i in range(len(other) - 49)}
    return {j for i in range(len(one) - 49) if tuple(one[i : i + 50]) in runs for j in range(i, i + 50)}


def test_against_all_pairs_with_common_lines(spark):
    """Exact passages between common lines of 10 to 45 words: every pair's words are reported by the later document, and only near copies else."""
    r = np.random.default_rng(8)
    lines = [words(r, n, f"line{n}x") for n in (10, 14, 20, 30, 40, 45)]
    texts = []
    for i in range(90):
        text = words(r, 40)
        passage = words(r, 5) + lines[i % 6] + words(r, 52 - len(lines[i % 6])) if i % 3 else []
        for _ in range(2 if i % 3 else 1):
            own = words(r, 30) + passage + lines[i % 6] + lines[(i + 1) % 6] + words(r, 30)
            texts.append(text[: i % 7] + own + (own[:60] if i % 11 == 0 else []))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = defaultdict(set)
    linked = set()
    for x in sub.repeated_passages(docs).collect():
        got[x.doc_id] |= set(range(x.first_word, x.end_word))
        linked |= {frozenset({x.doc_id, s}) for s in x.source_ids}
    keys = {r.doc_id: r.key for r in docs.selectExpr("doc_id", "xxhash64(doc_id, text) AS key").collect()}
    n = 0
    for i, a in enumerate(texts):
        want = set().union(*(slow_spans(a, b) for j, b in enumerate(texts) if keys[j] < keys[i]))
        assert want <= got[i], i
        n += bool(want)
    assert n > 30
    for pair in linked:
        i, j = pair
        assert slow_spans(texts[i], texts[j]) or len(set(zip(*(texts[i][k:] for k in range(5)))) & set(zip(*(texts[j][k:] for k in range(5))))) >= 36


def test_near_copies_between_which_an_earlier_document_has_a_part(spark):
    """A word changed amid 60, of which all documents hold 20 or 24 in the middle of the longer half."""
    r = np.random.default_rng(9)
    for size in (20, 24):
        part, rows = words(r, size, "part"), []
        for i in range(40):
            passage = words(r, 4) + part + words(r, 60 - size)
            changed = passage[:31] + ["changed"] + passage[32:]
            rows += [(2 * i, " ".join(words(r, 60) + passage + words(r, 60))), (2 * i + 1, " ".join(words(r, 60) + changed + words(r, 60)))]
        out = sub.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert {x.doc_id // 2 for x in out if x.first_word <= 60 and x.end_word >= 120} == set(range(40))


def test_a_text_that_repeats_a_pair_of_words(spark):
    r = np.random.default_rng(10)
    rows = [(i, " ".join(["tick tock"] * int(r.integers(20, 400)) + words(r, 60))) for i in range(60)]
    out = sub.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({x.doc_id for x in out}) == sum(len(t.split()) >= 110 for _, t in rows) - 1
    found = sub.windows(spark.createDataFrame(rows, "key long, text string"))
    assert found.groupBy("sig", "key").count().where("count > 1").isEmpty()


def test_columns_with_any_names(spark):
    r = np.random.default_rng(11)
    passage = words(r, 60)
    rows = [(i, " ".join(words(r, 20) + passage), 1, 2, 3) for i in range(3)] + [(9, None, 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key int, _spans int, __KEY int")
    out = sub.without_repeats(docs)
    assert out.columns == docs.columns and {(x["_key"], x["_spans"], x["__KEY"]) for x in out.collect()} == {(1, 2, 3)}
    assert sum(" ".join(passage) in (x.text or "") for x in out.collect()) == 1
