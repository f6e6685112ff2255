"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Targets share a budget of words among sources by weight, each stopping at a multiple of its source's size,
the excess going to the others. A source's whole epochs come first; the rest of its target is drawn without
replacement: documents in the order of exponential keys divided by their quality weights, up to the budget.

The order of one source is never sorted in one task. Keys fall into fine buckets of their logarithm; sizes
are summed per source and bucket (combined before the shuffle) and prefix-summed over the buckets, so only
the one bucket in which a source's budget ends is sorted by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.lineage import cut, spared

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[!|#$%&*@^~+=<>]"
WEIGHTS = (3, 1, 2)
BUCKETS = 256  # for each unit of the key's natural logarithm: at most 0.15 % of a source's documents each
SMALL = 10_000  # sources up to which their table is broadcast


def quality_weight(size: Column, text: Column) -> Column:
    """Between 0.05 and 1: of a mean word length near six bytes, and of few symbols that prose doesn't have.

    Without a classifier's score at hand this is what separates prose from junk in built-in functions alone (on the
    labelled documents of sf0.1 good ones stand above bad ones in 95 % of pairs; see tests/llm/test_mixing.py). Pass
    another column as ``weight`` where there is a score.
    """
    words = F.greatest(size, F.lit(1))
    length = 1 / (1 + F.abs(F.ln(F.greatest(F.octet_length(text) / words, F.lit(1.0)) / 6)))
    return F.greatest(F.lit(0.05), length / (1 + 4 * F.regexp_count(text, F.lit(SYMBOL)) / words))


def prepare(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", weight: Column | None = None, seed: int = 2026) -> DataFrame:
    """``docs`` with a column ``_mix``: size in words (null text: 0), key of the draw and the key's bucket.

    The key's uniform number is the first 52 bits of an MD5 of seed, id and text, so reruns agree and SQL elsewhere
    draws alike; ``weight`` is positive and may use any column (null: 1).
    """
    text = F.col(text_col)
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), text).cast("binary"))
    first = docs.withColumn("_mix", F.struct(size.alias("size"), F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").alias("hash")))
    uniform = (F.col("_mix.hash") + F.lit(0.5)) / F.lit(float(1 << 52))
    w = F.coalesce(weight if weight is not None else quality_weight(F.col("_mix.size"), text), F.lit(1.0))
    second = first.withColumn("_mix", F.struct("_mix.size", "_mix.hash", (-F.ln(uniform) / w).alias("key")))
    return second.withColumn("_mix", F.struct("_mix.*", F.floor(F.ln("_mix.key") * BUCKETS).cast("long").alias("bucket")))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(``source``, ``source_size``, ``target``) from (``source``, ``source_size``): one row per source.

    Sources by code point, null last, have the weights in turn. In the order of cap to weight, a source is
    capped exactly if the level reached with all earlier ones capped is not below its own.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("double")
    ranked = totals.select("*", w.alias("w"), (F.col("source_size") * most).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * share
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    found = ranked.select("*", level.alias("level"), (level >= F.col("cap") / F.col("w")).alias("full"))
    free = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    return found.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * free).alias("target"))


def draw(prepared: DataFrame, source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``prepared`` with (``source_size``, ``target``, ``copies``) added to ``_mix``.

    ``copies`` is how often the mix takes the whole document: the source's complete epochs, and once more if
    the middle of the document lies within what is left of the target, so a source misses its target by
    half a document at most. Sources may be null (a source of its own) or empty; a source without words
    has target 0; an empty table gives no rows. Of repeated rows any may be the one drawn.
    """
    source = F.col(source_col)
    filled = cut(prepared.groupBy(source.alias("source"), F.col("_mix.bucket").alias("bucket")).agg(F.sum("_mix.size").alias("words")))
    wanted = targets(filled.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    wanted = wanted.select("*", epochs.alias("epochs"), (F.col("target") - epochs * F.col("source_size")).alias("left"))
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    reached = filled.select("*", F.coalesce(F.sum("words").over(by_bucket), F.lit(0)).alias("before")).withColumnRenamed("source", "s")
    edge = reached.join(wanted, F.col("s").eqNullSafe(F.col("source"))).where("before <= left")
    edge = edge.groupBy("source").agg(F.max(F.struct("bucket", "before")).alias("edge"), *(F.first(c).alias(c) for c in ("source_size", "target", "epochs", "left")))
    edge = cut(edge.select(F.struct("source", "source_size", "target", "epochs", "left", F.col("edge.bucket").alias("bucket"), F.col("edge.before").alias("before")).alias("_edge")))
    if edge.count() <= SMALL:
        edge = F.broadcast(edge)
    all_rows = prepared.join(edge, source.eqNullSafe(F.col("_edge.source")))
    inside = Window.partitionBy("_edge.source").orderBy("_mix.key", "_mix.hash").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("_edge.before") + F.coalesce(F.sum("_mix.size").over(inside), F.lit(0)) + F.col("_mix.size") / 2
    away = all_rows.where("_mix.bucket <> _edge.bucket").withColumn("_more", F.col("_mix.bucket") < F.col("_edge.bucket"))
    at = all_rows.where("_mix.bucket = _edge.bucket").withColumn("_more", middle <= F.col("_edge.left"))
    copies = (F.col("_edge.epochs") + F.col("_more").cast("long")).cast("long")
    both = away.unionByName(at)
    return both.withColumn("_mix", F.struct("_mix.*", "_edge.source_size", "_edge.target", copies.alias("copies"))).select(prepared.columns)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns, whatever their names."""
    own = spared(docs, "_mix", "_edge", "_more")
    drawn = draw(prepare(own, **options))
    return drawn.withColumn("_mix", F.explode(F.array_repeat(F.lit(1), F.col("_mix.copies").cast("int")))).select(own.columns).toDF(*docs.columns)


#: The rows of the operator's query, for an engine that sorts each source whole.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    CAST('0x' || substr(md5(concat_ws(':', '2026', CAST(doc_id AS VARCHAR), text)), 1, 13) AS BIGINT) AS hash
  FROM documents
), weighed AS (
  SELECT *, greatest(0.05::DOUBLE, 1::DOUBLE / (1 + abs(ln(greatest(strlen(text)::DOUBLE / greatest(size, 1), 1::DOUBLE) / 6)))
    / (1 + (4 * len(regexp_extract_all(text, '[!|#$%&*@^~+=<>]')))::DOUBLE / greatest(size, 1))) AS quality
  FROM d
), keyed AS (
  SELECT *, -ln((hash + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / CASE WHEN text IS NULL THEN 1::DOUBLE ELSE quality END AS key
  FROM weighed
), totals AS (
  SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM keyed GROUP BY source
), capped AS (
  SELECT *, [3, 1, 2][(place - 1) % 3 + 1]::DOUBLE AS w, 2 * source_size AS cap FROM totals
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped
), targets AS (
  SELECT source, source_size, place, CASE WHEN level >= cap / w THEN cap ELSE w * (SELECT arg_min(level, cap / w) FROM levels WHERE level < cap / w) END AS target FROM levels
), parted AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM targets
), ordered AS (
  SELECT k.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY p.place ORDER BY key, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before
  FROM keyed k JOIN parted p ON k.source IS NOT DISTINCT FROM p.source
), taken AS (
  SELECT *, CAST(epochs + CASE WHEN before + size / 2::DOUBLE <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM ordered
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(size * copies AS BIGINT) AS taken, source, copies FROM taken
"""
