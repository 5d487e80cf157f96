"""Colours of pileup cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW_MAPQ = 20
CELL, MARGIN = 5, 5
#: Channel mean and standard deviation that image classifiers are commonly fed with. Fixed values.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def base_channel(base: Column, channel: str) -> Column:
    """A is red, T green, C blue, all others black."""
    return F.when(base == {"r": "A", "g": "T", "b": "C"}[channel], 255).otherwise(0)


def flag_index(paired: Column, proper: Column, mapq: Column, cigar_type: Column) -> Column:
    bit = lambda c, v: F.when(c, v).otherwise(0)
    return bit(~paired, 8) + bit(~proper, 4) + bit(mapq < LOW_MAPQ, 2) + bit(cigar_type == 4, 1)


def shaded(channel: Column, index: Column, clip: Column) -> Column:
    """The channel raised by the index's offset, at most 255, then by the clip count, within 0 to 255."""
    offset = F.when(index == 0, 0).otherwise(50 + 10 * index)
    return F.least(F.lit(255), F.greatest(F.lit(0), F.least(F.lit(255), channel + offset) + clip)).cast("int")


def rectangle(pos: Column, start: Column, row: Column) -> dict[str, Column]:
    x0, y0 = (pos - start) * CELL + MARGIN, MARGIN + row * CELL
    return {"x0": x0.cast("bigint"), "y0": y0.cast("bigint"), "x1": (x0 + CELL).cast("bigint"), "y1": (y0 + CELL).cast("bigint")}


def normalised(values: Column, mean: float, std: float) -> Column:
    """An array of 0..255 values scaled to [0, 1], then by mean and deviation."""
    return F.transform(values, lambda v: (v / F.lit(255.0) - mean) / std)
