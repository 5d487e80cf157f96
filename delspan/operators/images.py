"""Pileup images as tables of coloured cells, and their pixels on request."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.colours import base_channel, flag_index, rectangle, shaded

SIDE = 256


def cells(pileup: DataFrame, clips: DataFrame | None = None, palette: DataFrame | None = None) -> DataFrame:
    """``window_id, pos, row_idx, x0, y0, x1, y1, r, g, b`` for each pileup row.

    Without a palette, colours come from the base, raised by the offset of the read's flags and by the position's clip count. With one (kmer, r, g, b),
    a cell has its k-mer's colour as it is, and is black where the palette has none. ``clips`` may be left out if the pileup has ``clip``.
    """
    place = rectangle(F.col("pos"), F.col("start"), F.col("row_idx"))
    if palette is not None:
        rows = pileup.join(palette.select("kmer", "r", "g", "b"), "kmer", "left").fillna(0, ["r", "g", "b"])
        colours = [F.col(c).cast("int").alias(c) for c in "rgb"]
    else:
        rows = pileup if clips is None else pileup.join(clips.select("chrom", "pos", "clip"), ["chrom", "pos"], "left").withColumn("clip", F.coalesce("clip", F.lit(0)))
        index = flag_index(F.col("is_paired"), F.col("is_proper_pair"), F.col("mapq"), F.col("cigar_type"))
        colours = [shaded(base_channel(F.col("base"), c), index, F.col("clip")).alias(c) for c in "rgb"]
    return rows.select("window_id", "pos", "row_idx", *(v.alias(k) for k, v in place.items()), *colours)


def read_palette(spark: SparkSession, path: str) -> DataFrame:
    """``kmer, r, g, b`` from a JSON file of k-mers with lists of three numbers."""
    colours = F.from_json("value", "map<string, array<int>>")
    rows = spark.read.text(path, wholetext=True).select(F.explode(colours).alias("kmer", "colour"))
    return rows.select("kmer", *(F.col("colour")[k].alias(c) for k, c in enumerate("rgb")))


def render(cells: DataFrame, side: int = SIDE) -> DataFrame:
    """``window_id, pixels`` (side x side x 3 bytes). Rectangles include their end pixels and are drawn in the order (pos, row_idx)."""

    def draw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pos", "row_idx"])
        x0, y0, x1, y1 = (np.clip(rows[c].to_numpy(), 0, side) for c in ("x0", "y0", "x1", "y1"))
        high, wide = np.minimum(y1 + 1, side) - y0, np.minimum(x1 + 1, side) - x0
        size = high * wide
        # all pixels of all rectangles, those of later ones later: of several values for one pixel the last is kept
        cell = np.repeat(np.arange(len(rows)), size)
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        image = np.zeros((side, side, 3), np.uint8)
        image[y0[cell] + k // wide[cell], x0[cell] + k % wide[cell]] = rows[["r", "g", "b"]].to_numpy(np.uint8)[cell]
        return pd.DataFrame({"window_id": [key[0]], "pixels": [image.tobytes()]})

    # only rows that lie within the image are sent to the helper, at most (side / cell)^2 for each window
    return cells.where((F.col("y0") < side) & (F.col("x0") < side)).groupBy("window_id").applyInPandas(draw, "window_id string, pixels binary")
