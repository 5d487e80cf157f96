"""Operator 5: mixing sources to target weights by capped water-filling, in DataFrame operations only.

A source's size is the number of words of its documents. The sources share ``budget`` times all words by weight. No
source may give more than ``epochs`` times its words: a source above is clamped there and its excess goes to the
others by weight, until none is above. That end is the water level ``l`` at which the targets
``least(cap, weight * l)`` sum up to the budget, and it is found directly: in ascending order of ``cap / weight``
the clamped sources come first, so running sums over the (one row per source) table give the level.

A source with target ``t`` and size ``s`` repeats each document ``floor(t / s)`` whole times. The fractional repetition
takes documents in the order of a seeded hash until the rest of the target is reached, the last one if more than half
of it fits: the words taken differ from the target by at most half of one document (a group of equal ids counts as
one). Where the order is cut is found from sums over hash buckets, then over smaller ones within the one bucket of each source that holds
the cut, then within the one of these (one document in 16 million of the source); no source is ever sorted or gathered whole.

Defined results: a null text has size 0; null sources form one source, the last; null ids count as one id. Rows with
equal ids of one source are taken together. Sources without words get target 0 and take nothing; an empty table gives
an empty result. Other columns are kept by :func:`mixed` and not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUDGET, EPOCHS, SEED = 1.5, 2.0, "mix-1"
#: Up to so many sources the plan (a row of five numbers and two names each) is broadcast; beyond, joined by a shuffle.
BROADCAST_SOURCES = 20_000
#: How many digits of the hash name a bucket, and then a bucket within it.
BUCKET_DIGITS = (3, 6)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: float = EPOCHS) -> DataFrame:
    """``source, source_size, target`` from one row (``source, source_size``) for each source."""
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    by_level = everything.orderBy("full_at", "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("double")
    return (
        sizes.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("level", (F.lit(float(budget)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("open", F.col("full_at") > F.col("level"))
        .withColumn("water", F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.struct("full_at", "place"))).over(everything))
        .select("source", "source_size", F.when(F.col("open"), F.col("weight") * F.col("water")).otherwise(F.col("cap")).alias("target"))
    )


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """All rows of ``df`` as the struct ``row``, with ``size, source_size, target, times`` (how often the mix takes the document)."""
    key = order_key(F.col(id_col), seed)
    light = df.select(F.col(source_col).alias("source"), key.alias("key"), words(F.col(text_col)).alias("size"))
    plan = cut_in = None
    written: list[DataFrame] = []
    for digits in BUCKET_DIGITS:
        rows = light.select(F.col("source").alias("of"), F.substring("key", 1, digits).alias("bucket"), "size", F.lit(0).cast("long").alias("start"))
        if cut_in is not None:  # only what stands in the bucket of the cut is looked at more closely
            at = cut_in.select("of", F.col("bucket").alias("in"), "start")
            same = F.col("source").eqNullSafe(F.col("of")) & F.startswith("key", F.col("in"))
            rows = light.join(_bounded(at), same).select("of", F.substring("key", 1, digits).alias("bucket"), "size", "start")
        buckets = materialize(rows.groupBy("of", "bucket", "start").agg(F.sum("size").alias("words")), "buckets")
        if plan is None:
            plan = (
                targets(buckets.groupBy(F.col("of").alias("source")).agg(F.sum("words").alias("source_size")), weights, budget, epochs)
                .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
                .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
            )
        so_far = Window.partitionBy("of").orderBy("bucket")
        ends = buckets.withColumn("end", F.col("start") + F.sum("words").over(so_far)).join(plan.select(F.col("source").alias("name"), "rest"), F.col("of").eqNullSafe(F.col("name")))
        cut_in = ends.where((F.col("end") - F.col("words") <= F.col("rest")) & (F.col("rest") < F.col("end"))).select("of", "bucket", "rest", (F.col("end") - F.col("words")).alias("start"))
        cut_in = materialize(cut_in, "cut_in")  # at most one row for each source
        written += [buckets, cut_in]
    bucket = F.substring("key", 1, BUCKET_DIGITS[-1])
    ties = light.join(_bounded(cut_in), F.col("source").eqNullSafe(F.col("of")) & (bucket == F.col("bucket"))).groupBy("of", "bucket", "rest", "start", "key").agg(F.sum("size").alias("words"))
    within = Window.partitionBy("of").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = ties.withColumn("end", F.col("start") + F.sum("words").over(within)).where(2 * F.col("end") - F.col("words") <= 2 * F.col("rest")).groupBy("of").agg(F.max("key").alias("last"))
    cuts = cut_in.select("of", "bucket").join(last.withColumnRenamed("of", "of2"), F.col("of").eqNullSafe(F.col("of2")), "left").select("of", F.coalesce("last", "bucket").alias("cut"))
    cut = F.when(F.col("rest") > 0, F.col("cut"))  # documents without words take no fraction where none is left
    full = plan.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left").select(F.col("source").alias("of"), "source_size", "target", "whole", cut.alias("cut"))
    full = materialize(full, "mix_plan")
    discard(*written)
    full = _bounded(full)
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(source_col).alias("source"), key.alias("key"), words(F.col(text_col)).alias("size"))
    fraction = F.when(F.col("key") <= F.col("cut"), F.lit(1)).otherwise(F.lit(0))
    return rows.join(full, F.col("source").eqNullSafe(F.col("of"))).select("row", "size", "source_size", "target", (F.col("whole") + fraction).alias("times"))


def _bounded(plan: DataFrame) -> DataFrame:
    """The written per-source table, broadcast if it is short."""
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def taken_words(df: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: the words that the mix takes of each document, repeats counted."""
    return mixed(df, **options).select(F.col(f"row.{options.get('id_col', 'doc_id')}").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mix_documents(df: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``df``, each as often as it is taken."""
    copies = mixed(df, **options).where(F.col("times") > 0)
    return copies.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).select("row.*")


TAKEN_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (
  SELECT *, CAST(CASE (place - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, cap / weight AS full_at,
    (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
      / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT *, (SELECT level FROM l WHERE full_at > level ORDER BY full_at, place LIMIT 1) AS water FROM l),
p AS (
  SELECT source, source_size, CASE WHEN full_at > level THEN weight * water ELSE cap END AS target FROM t),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0::DOUBLE END AS whole FROM p),
k AS (
  SELECT source, k, sum(size) AS words FROM d GROUP BY source, k),
c AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM k)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, r.source_size, r.target,
  CAST(d.size * (r.whole + CASE WHEN 2 * c.run - c.words <= 2 * (r.target - r.whole * r.source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.k = c.k
"""
