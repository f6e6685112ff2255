"""The queries of this subpackage's operators; the contract's digests are derived here from their outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import itq, mixing, quality
from tidepanel.llm.chat import format_turns, read_back
from tidepanel.llm.graph import nearest
from tidepanel.llm.lineage import cut, read
from tidepanel.llm.mixing import draw, prepare
from tidepanel.llm.ngrams import score_all
from tidepanel.llm.packing import pack
from tidepanel.llm.sharding import assign
from tidepanel.llm.simhash import near_duplicates
from tidepanel.llm.substrings import repeated_passages


def op1_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=["doc_id"])
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = cut(prepare(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text"))
    taken = F.col("_mix.size") * F.col("_mix.copies")
    return draw(slim).select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", taken.alias("taken"), "source", "_mix.copies")


def op4_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_passages(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "first_word", (F.col("end_word") - F.col("first_word")).alias("n_words"), "source_id", "source_word", "source_ids")


def op5_iterative_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(read(spark, sf_dir, "embeddings"))


def op6_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    out, model = score_all(read(spark, sf_dir, "documents").select("doc_id", "text"), held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op7_consistent_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_chat_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(turns.unionByName(extra)))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.ORACLE_SQL}
