import re
from pathlib import Path

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tidepanel.llm.words import lean
from tests.llm.test_mixing import slow_targets
from tests.llm.test_packing import reference_ids
from tests.llm.test_simhash import slow_components, slow_fingerprint

DIR = "/root/testdata/sf0.001"


def test_every_stage_against_its_definition(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
        assert k == 4 or docs.columns == columns, name
    start, good, one, cleaned, mix, pieces = seen
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    kept = {r.doc_id for r in good}
    told = [(labels[r.doc_id], r.doc_id in kept) for r in start if r.doc_id in labels]
    assert sum(bool(q) == k for q, k in told) / len(told) > 0.95
    assert set(good) <= set(start)

    prints = {r.doc_id: slow_fingerprint(r.text) for r in good}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    assert sorted(one, key=lambda r: r.doc_id) == sorted((r for r in good if r.doc_id in set(slow_components(near, prints).values())), key=lambda r: r.doc_id)

    def grams(text, n=50):
        w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}

    owners = {}
    for r in one:
        for g in grams(r.text):
            owners.setdefault(g, set()).add(r.doc_id)
    shared = {i for s in owners.values() if len(s) > 1 for i in s}
    left = {r.doc_id: r for r in cleaned}
    again = {}
    for r in cleaned:
        assert r.n_chars == len(r.text)
        for g in grams(r.text):
            again.setdefault(g, set()).add(r.doc_id)
    assert all(len(s) == 1 for g, s in again.items() if g in owners)
    assert set(owners) <= set(again) | {g for g, s in owners.items() if s & {r.doc_id for r in one if left.get(r.doc_id) != r}}
    changed = {r.doc_id for r in one if left.get(r.doc_id) != r}
    assert len(changed - shared) <= 0.05 * len(one)

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    totals, taken, largest = {}, {}, {}
    for r in cleaned:
        totals[r.source] = totals.get(r.source, 0) + size(r.text)
        largest[r.source] = max(largest.get(r.source, 0), size(r.text))
    for r in mix:
        assert left[r.doc_id] == r
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
    want = slow_targets(totals)
    assert all(abs(taken.get(s, 0) - want[s]) <= largest[s] / 2 + 1e-6 for s in totals)
    assert sum(p.length for p in pieces) == sum(map(len, reference_ids([r.text for r in mix])))
    assert {p.doc_id for p in pieces} == {r.doc_id for r in mix}


def test_run_gives_the_packed_rows(spark):
    out = corpus_pipeline.run(spark, DIR)
    assert out.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "window", "step_group", "ids"] and out.count() > 0


def test_stages_with_odd_rows_and_names(spark, tmp_path):
    base = spark.read.parquet(f"{DIR}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (3, "", "en", "src0", 0), (3, "", "en", "src0", 0), (4, None, "en", None, 7), (4, "word " * 30000, "en", "src1", 150000)], base.schema)
    own = ("_score", "_kept", "_copy", "_key", "_spans", "_mix", "_edge", "_more", "key", "at", "id")
    docs = base.unionByName(odd).selectExpr("*", *(f"{k} AS {c}" for k, c in enumerate(own)))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        for r in spark.read.parquet(f"{tmp_path}/{k}").collect():
            assert tuple(r[c] for c in own) == tuple(range(len(own))), name
        assert stage(spark, docs.limit(0), DIR).count() == 0
    assert corpus_pipeline.packing(spark, docs, DIR).count() > 0


def test_a_table_without_lengths(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "x")], "doc_id long, text string, source string")
    assert corpus_pipeline.substring_dedup(spark, docs, DIR).columns == docs.columns


def test_stages_send_small_batches_to_workers(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.set(key, "10000")
            stage(spark, spark.read.parquet(f"{DIR}/documents.parquet").limit(20), DIR)
            assert [r.n for r in spark.range(0, 2500, 1, 1).mapInArrow(sizes, "n long").collect()] == [1000, 1000, 500], name
        spark.conf.set(key, "200")
        corpus_pipeline.packing(spark, spark.read.parquet(f"{DIR}/documents.parquet"), DIR)
        assert spark.conf.get(key) == "200"
    finally:
        spark.conf.set(key, before)


def test_a_worker_gives_its_memory_back_after_a_task():
    def held():
        return int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    def run(batches):
        blocks = [np.ones(8000) for _ in range(2000)]  # 122 MB in pieces that the C library keeps
        pins.append(np.ones(8000))
        yield from batches
        assert blocks

    pins = []
    assert list(run(iter([1, 2]))) == [1, 2]
    kept = held()
    assert list(lean(run)(iter([1, 2]))) == [1, 2]
    assert held() < kept - 80
