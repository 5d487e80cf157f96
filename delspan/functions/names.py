"""Window names: ``[sample_]kind_chrom_start_end``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"^(?:(.*?)_)??(non_del_up|non_del_down|non_del|del)_([^_]+)_(-?\d+)_(\d+)$"


def window_name(kind: Column, chrom: Column, start: Column, end: Column, sample: Column | None = None) -> Column:
    parts = [kind, chrom, start.cast("string"), end.cast("string")]
    return F.concat_ws("_", *([sample] if sample is not None else []), *parts)


def parsed(name: Column) -> Column:
    """``struct<sample, kind, chrom, start, end>``; null where the name doesn't follow the pattern."""
    part = lambda k: F.nullif(F.regexp_extract(name, PATTERN, k), F.lit(""))
    fields = F.struct(part(1).alias("sample"), part(2).alias("kind"), part(3).alias("chrom"), part(4).try_cast("bigint").alias("start"), part(5).try_cast("bigint").alias("end"))
    return F.when(part(2).isNotNull(), fields)
