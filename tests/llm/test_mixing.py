import re
from collections import defaultdict

import pytest

from tidepanel.llm import mixing


def slow_targets(sizes, share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] >= most * sizes[s]]
        if not over:
            out |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 50}, {"a": 0, "b": 0}, {"a": 5}, {f"s{i}": i * i for i in range(30)}, {"": 7, "é": 900, "Z": 3, "z": 4}])
def test_targets_match_resharing_by_hand(spark, sizes):
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = slow_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mix_reaches_its_targets_and_follows_key_order(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 90)), ("hot" if i % 3 else f"s{i % 11}") if i % 20 else None, i) for i in range(3000)]
    rows += [(5, None, "hot", 1), (6, "", "hot", 1), (None, "a b\tc\x0bd", "s1", 1), (7, "x y", "s1", 1), (7, "x y", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int").repartition(7)
    drawn = mixing.draw(mixing.prepare(docs)).collect()
    assert len(drawn) == len(rows)
    by = defaultdict(list)
    for r in drawn:
        assert r._mix.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        by[r.source].append(r._mix)
    want = slow_targets({s: sum(m.size for m in ms) for s, ms in by.items()})
    for s, ms in by.items():
        size = sum(m.size for m in ms)
        assert all(m.source_size == size and abs(m.target - want[s]) < 1e-6 * max(1, size) for m in ms)
        epochs, at = int(want[s] // size), 0
        for m in sorted(ms, key=lambda m: (m.key, m.hash)):
            assert m.copies == epochs + (at + m.size / 2 <= want[s] - epochs * size + 1e-9)
            at += m.size
        assert abs(sum(m.size * m.copies for m in ms) - want[s]) <= max(m.size for m in ms) / 2 + 1e-6
    again = mixing.draw(mixing.prepare(docs.repartition(2))).collect()
    assert sorted((r.doc_id or -1, r.text or "", r._mix.copies) for r in drawn) == sorted((r.doc_id or -1, r.text or "", r._mix.copies) for r in again)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r._mix.copies for r in drawn)


def test_empty_table(spark):
    assert mixing.mixed(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, source string")
    plan = mixing.mixed(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_columns_named_like_the_operators_own(spark):
    plain = spark.createDataFrame([(i, "a b c " * (i % 5), "xy"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    docs = plain.selectExpr("*", "doc_id AS _mix", "'e' AS _edge", "1 AS _MORE", "2 AS bucket", "3 AS source_size", "4 AS s", "5 AS __mix")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in mixing.mixed(plain).collect())
    assert all(r["_mix"] == r.doc_id and (r["_edge"], r["_MORE"], r.bucket, r.source_size, r.s, r["__mix"]) == ("e", 1, 2, 3, 4, 5) for r in rows)


def test_the_weight_follows_the_labels(spark):
    """Of a good and a bad labelled document the good one weighs more in at least nine pairs of ten."""
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.01"
    size = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0))
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", mixing.quality_weight(size, F.col("text")).alias("w"))
    rows = docs.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good, bad = [r.w for r in rows if r.quality], [r.w for r in rows if not r.quality]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) > 0.9 * len(good) * len(bad)
    assert all(0.05 <= w <= 1 for w in good + bad)


def test_query_against_the_definition(spark):
    from tidepanel.llm.queries import op3_mixing

    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = op3_mixing(spark, d).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in docs.items()}
    totals = defaultdict(int)
    for i, r in docs.items():
        totals[r.source] += sizes[i]
    want = slow_targets(totals)
    taken = defaultdict(int)
    for r in out:
        s = docs[r.doc_id].source
        assert (r.size, r.source_size) == (sizes[r.doc_id], totals[s]) and abs(r.target - want[s]) < 1e-6 and r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(sizes[i] for i, r in docs.items() if r.source == s) / 2 + 1e-6 for s in totals)


def test_query_equals_its_sql(spark, tmp_path):
    """With null and empty texts, sources and ids, repeated rows and a hot source."""
    import duckdb

    from tidepanel.llm import queries

    rows = [(i, " ".join(["wörd", "a|b"] * (1 + i * 7 % 90)), ("hot" if i % 3 else f"s{i % 11}") if i % 20 else None) for i in range(2000)]
    rows += [(5, None, "hot"), (6, "", "hot"), (None, "a b\tc\x0bd", "s1"), (7, "x y", "s1"), (7, "x y", "s1"), (8, None, "none"), (9, "z", "")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    order = ["doc_id", "size", "source_size", "target", "taken", "source", "copies"]
    got = [tuple(r) for r in queries.op3_mixing(spark, str(tmp_path)).select(order).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(order)} FROM ({queries.oracle_sql()['op3_mixing']})").fetchall()
    assert len(got) == len(rows) and sorted(got, key=str) == sorted(want, key=str)
