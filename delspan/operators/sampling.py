"""Quotas, balancing, limits, class weights and resampling, all repeatable by a seeded hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .variants import split

SEED = "seed-42"
BUCKET_DIGITS = 3


def shuffle_key(*cols: str, seed: str = SEED) -> Column:
    """The order of a seeded shuffle."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in cols)))


def first_by_key(rows: DataFrame, groups: list[str], order: list[Column], quota: Column, place: str | None = None, few_groups: bool = False) -> DataFrame:
    """The first ``quota`` rows of each group in the given order, whose first column is a shuffle key.

    Rows are counted by the key's first digits, and running totals over these few counts show how many rows come before each bucket, so rows are only
    ranked within (group, bucket): a group with most of the rows isn't sorted as a whole. Buckets beyond the quota are left out before they are dealt, and without
    ``place`` only the bucket that the quota falls into is. ``few_groups``: the buckets within the quota are so few that they may be broadcast. ``place``: a column for the row's place in its group, from 1.
    """
    bucket = F.substring(order[0], 1, BUCKET_DIGITS)
    rows = rows.withColumn("__bucket", bucket)
    before = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*groups, "__bucket").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    rows = rows.join(F.broadcast(counts) if few_groups else counts, [*groups, "__bucket"]).where(F.col("__before") < quota)  # later buckets have none of the first rows
    rank = F.col("__before") + F.row_number().over(Window.partitionBy(*groups, "__bucket").orderBy(*order))
    if place:
        return rows.withColumn(place, rank).where(F.col(place) <= quota).drop("__bucket", "__before", "__n")
    # of each group, only the rows of the bucket that the quota falls into are ranked
    full = F.col("__before") + F.col("__n") <= quota
    cut = rows.where(~full).withColumn("__rank", rank).where(F.col("__rank") <= quota).drop("__rank")
    return rows.where(full).unionByName(cut).drop("__bucket", "__before", "__n")


def quota(windows: DataFrame, limits: dict[str, int], seed: str = SEED) -> DataFrame:
    """The first windows of each chromosome and kind, up to that kind's limit: regions in shuffled order, each one's windows by position.

    Give only windows that have data: a quota counts what is kept.
    """
    wanted = F.element_at(F.create_map(*(F.lit(x) for item in limits.items() for x in item)), F.col("kind"))
    order = [shuffle_key("region_id", seed=seed), F.col("region_id"), F.col("start")]
    return first_by_key(windows.where(F.col("kind").isin(*limits)), ["chrom", "kind"], order, wanted, place="__place", few_groups=True).drop("__place")  # few rows: one pass


def balanced(windows: DataFrame, seed: str = SEED) -> DataFrame:
    """As many windows of each label as the rarer label has, picked by a shuffle."""
    counts = windows.groupBy("label").agg(F.count("*").alias("n"))
    least = counts.agg(F.when(F.count("*") == 2, F.min("n")).otherwise(F.lit(0)).alias("least"))
    rows = windows.join(F.broadcast(least))  # one row
    return first_by_key(rows, ["label"], [shuffle_key("window_id", seed=seed), F.col("window_id")], F.col("least"), few_groups=True).drop("least")


def limited(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in an explicit order."""
    return rows.orderBy(*order).limit(n)


def with_split(rows: DataFrame) -> DataFrame:
    """Rows of training and validation chromosomes with ``split``; others go."""
    return rows.withColumn("split", split(F.col("chrom"))).where(F.col("split").isNotNull())


def class_weights(rows: DataFrame) -> DataFrame:
    """``label, n, weight``: all rows / (2 * the label's rows), for labels 0 and 1."""
    counts = rows.agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    n0, n1 = F.col("n0"), F.col("n1")
    one = lambda label, n: F.struct(F.lit(label).alias("label"), n.alias("n"), ((n0 + n1) / (2.0 * F.greatest(n, F.lit(1)))).alias("weight"))
    return counts.select(F.explode(F.array(one(0, n0), one(1, n1))).alias("w")).select("w.*")


def resampled(rows: DataFrame, n: int, id_col: str = "window_id", seed: str = SEED) -> DataFrame:
    """Exactly ``n`` draws with replacement, each label equally likely: rows as often as they are drawn.

    Draw ``k`` takes a label, then a place among the label's rows in shuffled order, both by hashes of ``k``. Places are counted by hash buckets, so rows are
    only ranked within (label, bucket). ``id_col`` names the rows.
    """
    counts = {r.label: r.n for r in class_weights(rows).collect() if r.n}  # at most two rows
    if not counts:
        return rows.limit(0)
    key = shuffle_key(id_col, seed=seed)
    placed = first_by_key(rows, ["label"], [key, F.col(id_col)], F.lit((1 << 63) - 1), place="__place")
    number = lambda what, mod: F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|{what}|"), F.col("id").cast("string"))), 1, 12), 16, 10).cast("bigint"), mod)
    labels = F.array(*map(F.lit, sorted(counts)))
    draws = rows.sparkSession.range(n).withColumn("label", F.get(labels, number("label", F.lit(len(counts))).cast("int")))
    size = F.element_at(F.create_map(*(F.lit(x) for item in counts.items() for x in item)), F.col("label"))
    draws = draws.select("label", (number("row", size) + 1).alias("__place")).groupBy("label", "__place").agg(F.count("*").alias("__times"))
    drawn = placed.join(draws, ["label", "__place"])
    return drawn.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*rows.columns)
