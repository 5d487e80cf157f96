"""Windows over regions, the interval-overlap join, and merging intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WINDOW, LEAST = 50, 5
#: Position bins by which windows and reads meet, about as wide as both.
BIN = 128
MERGE_BIN = 1_000_000
#: Bits of the widths of nested position bins; the last level is a whole chromosome.
LEVELS = (10, 13, 16, 19, 22, 25, 28)


def tile(regions: DataFrame, size: int = WINDOW, min_width: int = LEAST) -> DataFrame:
    """Windows of ``size`` over regions (region_id, kind, chrom, start, end), the last cut; those below ``min_width`` or before position 0 go.

    Adds ``window_id`` and ``label`` (1 for kind ``del``).
    """
    some = regions.where(F.col("end") > F.col("start"))
    rows = some.withColumn("w", F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(size).cast("bigint"))))
    rows = rows.select("region_id", "kind", F.when(F.col("kind") == "del", 1).otherwise(0).alias("label"), "chrom", F.col("w").alias("start"), F.least(F.col("w") + size, "end").alias("end"))
    rows = rows.where((F.col("end") - F.col("start") >= max(min_width, LEAST)) & (F.col("start") >= 0))
    return rows.withColumn("window_id", F.concat_ws("_", "region_id", "kind", "start"))


def dataset_windows(regions: DataFrame, anchors: DataFrame, size: int = WINDOW, min_width: int = WINDOW // 2) -> DataFrame:
    """The labelled windows of deletions and of their anchors."""
    both = regions.select("region_id", F.lit("del").alias("kind"), "chrom", "start", "end").unionByName(anchors.select("region_id", "kind", "chrom", "start", "end"))
    return tile(both, size, min_width)


def _nested(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Rows that have a width, with ``level`` and ``bin`` of the smallest bin that holds them whole."""
    level = sum((F.shiftright(start, k) != F.shiftright(F.col(end) - 1, k)).cast("int") for k in LEVELS)
    rows = rows.where(F.col(end) > F.col(start)).withColumn("level", level)
    return rows.withColumn("bin", F.expr(f"CASE WHEN level = {len(LEVELS)} THEN 0 ELSE shiftright({start}, {LEVELS[0]} + level * {LEVELS[1] - LEVELS[0]}) END"))


def _asking(rows: DataFrame, start: str, first: int) -> DataFrame:
    """The rows once for each level from ``first`` above their own, with the bin of that level that holds them."""
    rows = rows.where(F.col("level") + first <= len(LEVELS)).withColumn("level", F.explode(F.sequence(F.col("level") + first, F.lit(len(LEVELS)))))
    return rows.withColumn("bin", F.expr(f"CASE WHEN level = {len(LEVELS)} THEN 0 ELSE shiftright({start}, {LEVELS[0]} + level * {LEVELS[1] - LEVELS[0]}) END"))


def overlap_join(a: DataFrame, b: DataFrame, a_ends: tuple[str, str] = ("ref_start", "ref_end"), b_ends: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Pairs with ``a_start < b_end`` and ``a_end > b_start`` on one ``chrom``, for intervals of any width. Other columns must have different names.

    Position bins are nested, each level eight times as wide as the one before. An interval stands in one bin, the smallest that holds it whole. If two
    overlap, the bin of the higher one holds the lower one's. So each interval is one row where it stands, and one for each level from its own upwards where
    it asks, never more than there are levels, however wide it is; each pair is found once, without a distinct. Many intervals in one wide bin are a
    skewed partition of an inner join, which adaptive execution splits.
    """
    a, b = _nested(a, *a_ends), _nested(b, *b_ends)
    on = ["chrom", "level", "bin"]
    pairs = a.join(_asking(b, b_ends[0], 0), on).unionByName(_asking(a, a_ends[0], 1).join(b, on))
    return pairs.where((F.col(a_ends[0]) < F.col(b_ends[1])) & (F.col(a_ends[1]) > F.col(b_ends[0]))).drop("level", "bin")


def window_join(reads: DataFrame, windows: DataFrame, width: int = WINDOW, bin_size: int = BIN) -> DataFrame:
    """The pairs of reads (ref_start, ref_end) and windows that overlap, for windows of at most ``width`` (a wider one is an error), with ``bin``.

    A window is dealt to the bin of its start only, and a read to all bins where windows that it overlaps may start. So a window has all its pairs in one
    partition, and what follows by (chrom, bin, window_id) needs no further shuffle.
    """
    pairs = _by_window_start(reads, width, bin_size).join(_at_start(windows, width, bin_size), ["chrom", "bin"])
    return pairs.where((F.col("ref_start") < F.col("end")) & (F.col("ref_end") > F.col("start")))


def _by_window_start(reads: DataFrame, width: int, bin_size: int) -> DataFrame:
    """Reads once for each bin in which a window that they overlap may start."""
    span = F.sequence(F.floor((F.col("ref_start") - (width - 1)) / bin_size), F.floor((F.col("ref_end") - 1) / bin_size))
    return reads.where(F.col("ref_end") > F.col("ref_start")).withColumn("bin", F.explode(span))


def store_by_bin(reads: DataFrame, table: str, path: str, buckets: int, width: int = WINDOW, bin_size: int = BIN) -> None:
    """Write reads (with ``ref_end``) as the table ``table`` in ``path``, once and for all in the layout in which windows meet them.

    Rows are dealt into ``buckets`` by (chrom, bin) and sorted by these and their starts, one file a bucket. Joins by :func:`stored_window_join` then read each bucket
    where it lies, and a file's least and greatest bins tell what a filter need not read.
    """
    rows = _by_window_start(reads, width, bin_size).repartition(buckets, "chrom", "bin")
    rows.write.bucketBy(buckets, "chrom", "bin").sortBy("chrom", "bin", "ref_start").option("path", path).mode("overwrite").saveAsTable(table)


def stored_window_join(stored: DataFrame, windows: DataFrame, width: int = WINDOW, bin_size: int = BIN) -> DataFrame:
    """The pairs of :func:`window_join` from a table of :func:`store_by_bin` (with its ``width`` and ``bin_size``); only windows are shuffled."""
    return stored.join(_at_start(windows, width, bin_size), ["chrom", "bin"]).where((F.col("ref_start") < F.col("end")) & (F.col("ref_end") > F.col("start")))


def _at_start(windows: DataFrame, width: int, bin_size: int) -> DataFrame:
    """Windows with the bin of their start; a wider one than ``width`` is an error."""
    wide = F.raise_error(F.lit(f"a window is wider than {width}")).cast("bigint")
    return windows.where(F.col("end") > F.col("start")).withColumn("bin", F.when(F.col("end") - F.col("start") > width, wide).otherwise(F.floor(F.col("start") / bin_size)))


def merge_adjacent(calls: DataFrame, gap: int = 0) -> DataFrame:
    """Calls (chrom, start, end, prob) at most ``gap`` apart become one: ``chrom, start, end, mean_prob, max_prob, n``.

    Calls become islands within position bins first. Across bins only one row for each bin is looked at, to find how far the calls of earlier bins
    reach; only a bin's first islands can be joined to earlier ones, and only what reaches beyond its bin is passed on, so no chromosome is gathered.
    """
    rows = calls.select("chrom", "start", "end", F.col("prob").alias("total"), F.col("prob").alias("most"), F.lit(1).cast("bigint").alias("n"), F.floor(F.col("start") / MERGE_BIN).alias("bin"))
    order = Window.partitionBy("chrom", "bin").orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    bins = rows.groupBy("chrom", "bin").agg(F.max("end").alias("reach"))
    reach = F.max("reach").over(Window.partitionBy("chrom").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.select("chrom", "bin", reach.alias("reach"))
    rows = rows.join(bins, ["chrom", "bin"])
    # the greatest end of all calls before this one, in its bin or an earlier one; null for a chromosome's first
    rows = rows.withColumn("seen", F.greatest(F.max("end").over(before), "reach"))
    rows = rows.withColumn("opens", F.coalesce(F.col("start") > F.col("seen") + gap, F.lit(True)))
    # an island is named by the start of the call that opens it; what a bin has before its first such call goes on with the last island of earlier bins
    rows = rows.withColumn("island", F.max(F.when(F.col("opens"), F.col("start"))).over(upto))
    opened = rows.groupBy("chrom", "bin").agg(F.max("island").alias("last"))
    earlier = F.last("last", ignorenulls=True).over(Window.partitionBy("chrom").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    opened = opened.select("chrom", "bin", earlier.alias("earlier"))
    parts = rows.groupBy("chrom", "bin", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("total").alias("total"), F.max("most").alias("most"), F.sum("n").alias("n"))
    whole = parts.join(opened, ["chrom", "bin"]).groupBy("chrom", F.coalesce("island", "earlier").alias("island"))
    merged = whole.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("total").alias("total"), F.max("most").alias("most"), F.sum("n").alias("n"))
    return merged.select("chrom", "start", "end", (F.col("total") / F.col("n")).alias("mean_prob"), F.col("most").alias("max_prob"), "n")
