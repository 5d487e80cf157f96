"""Selecting deletions, classifying and filtering them, and their anchor regions."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEX = ("X", "Y", "chrX", "chrY")
TRAIN, VALIDATION = tuple(map(str, range(1, 12))), tuple(map(str, range(12, 23)))
ANCHOR_GAP, ANCHOR_MAX = 150, 700
CLASSES = ("SMALL", "MEDIUM", "LARGE", "VERY_LARGE")


def size_class(length: Column) -> Column:
    """Half-open classes from 200, 700 and 1000; everything shorter is SMALL."""
    return F.when(length < 200, "SMALL").when(length < 700, "MEDIUM").when(length < 1000, "LARGE").otherwise("VERY_LARGE")


def is_deletion() -> Column:
    return F.coalesce(F.col("svtype") == "DEL", F.lit(False)) | F.coalesce(F.array_contains("alts", "<DEL>"), F.lit(False))


def regions(records: DataFrame, variant_type: str = "deletion", carriers: bool = False) -> DataFrame:
    """``region_id, chrom, start, end, sv_type, length, size_class`` of variant records.

    Only ``variant_type="deletion"`` filters by type; any other value keeps all records. With ``carriers``,
    to be asked for where a sample is named, records need an allele above 0 in ``gt``. The end is the
    stated one, else that of the reference allele. ``start`` is the record's 1-based position, used as it is.
    """
    rows = records.where(is_deletion()) if variant_type == "deletion" else records
    if carriers:
        rows = rows.where(F.coalesce(F.exists("gt", lambda a: a > 0), F.lit(False)))
    kind = F.coalesce("svtype", F.when(is_deletion(), "DEL").otherwise("UNKNOWN"))
    end = F.coalesce("info_end", F.col("pos") - 1 + F.length("ref"))
    rows = rows.select(F.col("id").alias("region_id"), "chrom", F.col("pos").alias("start"), end.alias("end"), kind.alias("sv_type"))
    return rows.withColumn("length", F.abs(F.col("end") - F.col("start"))).withColumn("size_class", size_class(F.col("length")))


def selected(regions: DataFrame, classes: tuple[str, ...] | None = None, chroms: tuple[str, ...] | None = None, max_length: int | None = None, exclude: tuple[str, ...] = (), lenient: bool = False) -> DataFrame:
    """Regions of some size classes, chromosomes and lengths (inclusive; 0 or None: any), without excluded chromosomes.

    An unknown size class is an error, or with ``lenient`` is left out with a warning.
    """
    unknown = sorted(set(classes or ()) - set(CLASSES))
    if unknown and not lenient:
        raise ValueError(f"unknown size classes {', '.join(unknown)}; there are {', '.join(CLASSES)}")
    if unknown:
        warnings.warn(f"unknown size classes {', '.join(unknown)} are left out", stacklevel=2)
    keep = F.lit(True)
    if classes:
        keep = keep & F.col("size_class").isin(*classes)
    if chroms:
        keep = keep & F.col("chrom").isin(*chroms)
    if max_length:
        keep = keep & (F.col("length") <= max_length)
    if exclude:
        keep = keep & ~F.col("chrom").isin(*exclude)
    return regions.where(keep)


def anchors(regions: DataFrame) -> DataFrame:
    """Control regions before (``up``) and after (``down``) each region, ``ANCHOR_GAP`` away; long ones are cut to four fifths."""
    size = F.when(F.col("length") > ANCHOR_MAX, F.floor(4 * F.col("length") / 5)).otherwise(F.col("length"))
    up = F.struct(F.lit("up").alias("kind"), (F.col("start") - size - ANCHOR_GAP).alias("start"), (F.col("start") - ANCHOR_GAP).alias("end"))
    down = F.struct(F.lit("down").alias("kind"), (F.col("end") + ANCHOR_GAP).alias("start"), (F.col("end") + ANCHOR_GAP + size).alias("end"))
    both = regions.select("region_id", "chrom", F.explode(F.array(up, down)).alias("a")).select("region_id", "chrom", "a.*")
    return both.select("region_id", "kind", "chrom", "start", "end", F.lit("NON_DEL").alias("sv_type"))


def split(chrom: Column) -> Column:
    return F.when(chrom.isin(*TRAIN), "train").when(chrom.isin(*VALIDATION), "validation")
