"""Reads: ends, depth, clips, pileups.

Reads are (qname, flag, chrom, ref_start, mapq, cigar, tlen, seq, qual). Positions are expanded only where they are needed, and the
read's sequence never travels with them: each expanded row carries its one base and quality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import blocks
from ..functions.cigar import ALIGNED, CLIPS, GAPS, KMER_HALF
from .regions import window_join

PAIRED, PROPER, UNMAPPED, SECONDARY, QC_FAIL, DUPLICATE = 1, 2, 4, 256, 512, 1024
NOT_COUNTED = UNMAPPED | SECONDARY | QC_FAIL | DUPLICATE
DEPTH_BIN, PILEUP_BIN = 1024, 64
#: The greatest quality that two agreeing mates add up to.
SUM_LIMIT = 200
#: So many reads of one position bin in a batch are added up before they are dealt.
DENSE = 48


@dataclass(frozen=True)
class PileupOptions:
    """What a pileup leaves out; the defaults are those of common pileup tools."""

    min_base_quality: int = 13
    exclude_flags: int = NOT_COUNTED
    ignore_orphans: bool = True
    one_of_overlapping_mates: bool = True
    max_depth: int = 8000


def has_flag(bits: int) -> Column:
    return F.col("flag").bitwiseAND(bits) != 0


_OPERATION = T.StructType([T.StructField("op", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("len", "q", "r"))])


@F.arrow_udf(T.StructType([T.StructField("ref_end", T.LongType()), T.StructField("ops", T.ArrayType(_OPERATION))]))
def placed(cigars: pa.Array, starts: pa.Array) -> pa.Array:
    """The end on the reference (null where nothing consumes it) and the operations with their offsets, a batch of reads at a time."""
    return blocks.placed(cigars, starts)


def with_operations(reads: DataFrame) -> DataFrame:
    """Adds ``ops`` (with offsets) and ``ref_end``."""
    rows = reads.withColumn("placed", placed(F.col("cigar"), F.col("ref_start").cast("long")))
    return rows.withColumns({"ref_end": F.col("placed.ref_end"), "ops": F.col("placed.ops")}).drop("placed")


def base_at(q: Column) -> Column:
    return F.substr("seq", (q + 1).cast("int"), F.lit(1)).cast("string")


def quality_at(q: Column) -> Column:
    return F.ascii(F.substr("qual", (q + 1).cast("int"), F.lit(1)).cast("string")) - 33


def aligned_positions(reads: DataFrame, *keep: str, low: Column | None = None, high: Column | None = None, gaps: bool = False) -> DataFrame:
    """One row for each reference position of each read: ``keep``, ``pos``, ``qpos`` (null in deletions and skips), ``base``, ``quality``.

    ``reads`` has ``ops``. With ``low`` and ``high`` only positions in [low, high) are made. ``gaps``: whether deleted and skipped
    positions are rows too.
    """
    low = F.col("ref_start") if low is None else low
    high = F.col("ref_end") if high is None else high
    ops = F.filter("ops", lambda o: o["op"].isin(*ALIGNED, *(GAPS if gaps else ())) & (o["r"] < high) & (o["r"] + o["len"] > low))
    rows = reads.withColumn("o", F.explode(ops)).withColumn("pos", F.explode(F.sequence(F.greatest("o.r", low), F.least(F.col("o.r") + F.col("o.len"), high) - 1)))
    qpos = F.when(F.col("o.op").isin(*ALIGNED), F.col("o.q") + F.col("pos") - F.col("o.r"))
    return rows.withColumn("qpos", qpos).select(*keep, "pos", "qpos", F.upper(base_at(F.col("qpos"))).alias("base"), quality_at(F.col("qpos")).alias("quality"))


def dealt(reads: DataFrame, bin_size: int, *keep: str) -> DataFrame:
    """Reads with operations, once for each position bin that they touch, dealt by (chrom, bin): what follows by these, and positions, isn't shuffled again.

    Adds ``bin``, and ``low`` and ``high``, what the bin holds of the read. ``seq`` and ``qual`` become binary, so that a letter is found at its place.
    """
    rows = reads.where(F.col("ref_end") > F.col("ref_start")).select("chrom", "ref_start", "ref_end", "ops", F.upper("seq").cast("binary").alias("seq"), F.col("qual").cast("binary").alias("qual"), *keep)
    rows = rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col("ref_start") / bin_size), F.floor((F.col("ref_end") - 1) / bin_size)))).repartition("chrom", "bin")
    return rows.withColumns({"low": F.greatest(F.col("ref_start"), F.col("bin") * bin_size), "high": F.least(F.col("ref_end"), (F.col("bin") + 1) * bin_size)})


def _base_counts(reads: DataFrame, min_quality: int, exclude_flags: int, bins: DataFrame | None, task, schema: str, plain: bool = False) -> DataFrame:
    """What ``task`` makes of (chrom, bin, counts of A, C, G, T at each position), for each position bin that reads cover.

    Reads become strings of counted bases, one for each bin that they touch; where a batch has ``DENSE`` of a bin or more, their sums take their place,
    so no bin, however deep, is more rows than a few from each task. They are dealt by (chrom, bin) and added up bin by bin. ``plain``: all letters count as A, which is less to deal.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chrom", "bin", "offset", "bases", "sums"]
        for batch in blocks.slices(batches, 4096):
            column = [batch.column(k) for k in range(5)]
            row, pos, base = blocks.counted_bases(*column[1:], min_quality)
            base = np.minimum(base, 1) if plain else base
            bin_ = pos // DEPTH_BIN
            first = blocks.runs(row, bin_)
            if not len(first):
                continue
            last = np.r_[first[1:], len(row)] - 1
            chrom = column[0].dictionary_encode()
            code = np.asarray(chrom.indices.fill_null(-1))[row[first]]
            _, of = np.unique(np.stack([code, bin_[first]]), axis=1, return_inverse=True)
            many = np.bincount(of)[of] >= DENSE
            size = np.where(many, 0, pos[last] - pos[first] + 1)
            put = np.cumsum(size) - size
            which = np.repeat(np.arange(len(first)), last - first + 1)
            spelled = np.zeros(size.sum(), np.uint8)
            thin = ~many[which]
            spelled[(put[which] + pos - pos[first][which])[thin]] = base[thin]
            few = np.flatnonzero(~many)
            if len(few):
                ends = np.r_[put[few], len(spelled)].astype(np.int32)
                strings = pa.Array.from_buffers(pa.binary(), len(few), [None, pa.py_buffer(ends), pa.py_buffer(spelled)])
                yield pa.RecordBatch.from_arrays([column[0].take(pa.array(row[first[few]])), pa.array(bin_[first[few]]), pa.array((pos[first[few]] % DEPTH_BIN).astype(np.int32)), strings, pa.nulls(len(few), pa.binary())], names)
            if many.any():
                groups, at = np.unique(of[many], return_index=True)
                number = np.full(of.max() + 1, -1)
                number[groups] = np.arange(len(groups))
                thick = ~thin
                place = (number[of[which[thick]]] * DEPTH_BIN + pos[thick] % DEPTH_BIN) * 4 + base[thick] - 1
                sums = np.bincount(place, minlength=len(groups) * DEPTH_BIN * 4).astype("<i4").reshape(len(groups), -1)
                one = first[np.flatnonzero(many)[at]]
                yield pa.RecordBatch.from_arrays([column[0].take(pa.array(row[one])), pa.array(bin_[one]), pa.array(np.zeros(len(one), np.int32)), pa.nulls(len(one), pa.binary()), pa.array([x.tobytes() for x in sums], pa.binary())], names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last bin so far, which may go on
        for batch in blocks.slices(batches, 2048):
            chrom, bin_ = batch.column(0).to_numpy(zero_copy_only=False), np.asarray(batch.column(1))
            first = blocks.runs(chrom, bin_)
            group = np.zeros(len(bin_), np.int64)
            group[first[1:]] = 1
            group = np.cumsum(group)
            thin = np.flatnonzero(np.asarray(batch.column(3).is_valid()))
            raw, ends = blocks.letters(batch.column(3).take(pa.array(thin)).cast(pa.binary()))
            which, k = blocks.spread(np.diff(ends))
            base = raw[ends[0] : ends[-1]].astype(np.int64)
            place = (group[thin][which] * DEPTH_BIN + np.asarray(batch.column(2))[thin][which] + k) * 4 + base - 1
            counts = np.bincount(place[base > 0], minlength=len(first) * DEPTH_BIN * 4).reshape(len(first), DEPTH_BIN, 4)
            for i in np.flatnonzero(np.asarray(batch.column(4).is_valid())).tolist():
                counts[group[i]] += np.frombuffer(batch.column(4)[i].as_buffer(), "<i4").reshape(DEPTH_BIN, 4)
            if held is not None:
                if (held[0], held[1]) == (chrom[0], bin_[0]):
                    counts[0] += held[2]
                else:
                    yield task([held[0]], np.array([held[1]]), held[2][None])
            if len(first) > 1:
                yield task(chrom[first[:-1]], bin_[first[:-1]], counts[:-1])
            held = (chrom[-1], bin_[-1], counts[-1])
        if held is not None:
            yield task([held[0]], np.array([held[1]]), held[2][None])

    kept = reads.where(~has_flag(exclude_flags)).select("chrom", F.col("ref_start").cast("long"), "cigar", "seq", "qual")
    rows = kept.mapInArrow(spell, "chrom string, bin long, offset int, bases binary, sums binary")
    rows = rows.repartition("chrom", "bin")
    if bins is not None:
        rows = rows.join(bins.select("chrom", "bin").distinct(), ["chrom", "bin"], "left_semi")  # where they lie
    return rows.sortWithinPartitions("chrom", "bin").mapInArrow(add, schema)


def depth(reads: DataFrame, min_quality: int = 15, exclude_flags: int = NOT_COUNTED) -> DataFrame:
    """``chrom, pos, depth, a, c, g, t``: bases of that quality or more over each covered position."""

    def positions(chrom, bin_: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        depth = counts.sum(2)
        row, k = np.nonzero(depth)
        columns = [pa.array(chrom, pa.string()).take(pa.array(row)), pa.array(bin_[row] * DEPTH_BIN + k), pa.array(depth[row, k]), *(pa.array(counts[row, k, b]) for b in range(4))]
        return pa.RecordBatch.from_arrays(columns, ["chrom", "pos", "depth", "a", "c", "g", "t"])

    return _base_counts(reads, min_quality, exclude_flags, None, positions, "chrom string, pos long, depth long, a long, c long, g long, t long")


def depth_arrays(reads: DataFrame, min_quality: int = 15, exclude_flags: int = NOT_COUNTED, bins: DataFrame | None = None) -> DataFrame:
    """``chrom, bin, depth``: the depth at all ``DEPTH_BIN`` positions of each covered bin, of those in ``bins`` (chrom, bin) if given."""

    def arrays(chrom, bin_: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        ends = np.arange(len(bin_) + 1, dtype=np.int32) * DEPTH_BIN
        return pa.RecordBatch.from_arrays([pa.array(chrom, pa.string()), pa.array(bin_), pa.ListArray.from_arrays(pa.array(ends), pa.array(counts.sum(2).ravel()))], ["chrom", "bin", "depth"])

    return _base_counts(reads, min_quality, exclude_flags, bins, arrays, "chrom string, bin long, depth array<long>", plain=True)


def clips(reads: DataFrame) -> DataFrame:
    """``chrom, pos, clip``: alignments clipped (softly or hard) at their first or last position. No flag is looked at.

    A clip at the left counts at the read's start even if nothing of the read is aligned; one at the right needs an end.
    """
    number = r"\d+"
    ends = F.array_compact(F.array(F.when(F.col("cigar").rlike(f"^{number}[SH]"), F.col("ref_start")), F.when(F.col("cigar").rlike("[SH]$"), F.col("ref_end") - 1)))
    rows = with_operations(reads.where(F.col("cigar").rlike(f"^{number}[SH]|[SH]$")))
    return rows.select("chrom", F.explode(ends).alias("pos")).groupBy("chrom", "pos").agg(F.count("*").alias("clip"))


def reads_in_windows(reads: DataFrame, windows: DataFrame) -> DataFrame:
    """Reads with their operations, once for each window that they overlap, and the window's ``bin``. Group by (chrom, bin, window_id)."""
    return window_join(with_operations(reads), windows.select("window_id", "chrom", "start", "end"))


def mated_quality() -> Column:
    """The quality of a base that counts where two mates, paired reads of one name, stand over one position.

    If they agree, the first (by start, then flag) gets the sum of both, at most ``SUM_LIMIT``; if not, the better one, the first of equals, keeps four fifths of
    its own, rounded down. The other one gets 0. More reads of one name are taken two by two. This comes before the quality filter.
    """
    mates = Window.partitionBy("chrom", "bin", "pos", "qname", has_flag(PAIRED)).orderBy("ref_start", "flag")
    second = F.row_number().over(mates) % 2 == 0
    mate = lambda c: F.when(second, F.lag(c).over(mates)).otherwise(F.lead(c).over(mates))
    own, other = F.col("quality"), mate("quality")
    agree = F.least(own + other, F.lit(SUM_LIMIT))
    alone = ~has_flag(PAIRED) | other.isNull()
    better = (own > other) | ((own == other) & ~second)
    return F.when(alone, own).when(mate("base") == F.col("base"), F.when(second, 0).otherwise(agree)).otherwise(F.when(better, F.floor(own * 4 / 5)).otherwise(0)).cast("int")


def pileup(reads: DataFrame, windows: DataFrame, options: PileupOptions = PileupOptions(), clips: DataFrame | None = None) -> DataFrame:
    """``window_id, start, chrom, pos, row_idx, is_paired, is_proper_pair, mapq, cigar_type, base, kmer``, with ``clips`` also ``clip``.

    A row for each base that stands over a window's position; ``row_idx`` counts the reads of a position in the order (ref_start,
    qname, flag). Where mates overlap, one base stands for both, see :func:`mated_quality`. Nothing of this depends on the window, so positions are ranked once, within
    the bins that reads are dealt to, and windows, however many overlap, are joined to ranked positions.
    """
    kept = reads.where(~has_flag(options.exclude_flags))
    if options.ignore_orphans:
        kept = kept.where(~(has_flag(PAIRED) & ~has_flag(PROPER)))
    pad = F.lit("N" * KMER_HALF)
    kept = with_operations(kept).withColumn("padded", F.concat(pad, "seq", pad).cast("binary"))
    rows = dealt(kept, PILEUP_BIN, "qname", "flag", "mapq", "padded")
    ops = F.filter("ops", lambda o: o["op"].isin(*ALIGNED) & (o["r"] < F.col("high")) & (o["r"] + o["len"] > F.col("low")))
    rows = rows.withColumn("o", F.explode(ops)).withColumn("pos", F.explode(F.sequence(F.greatest("o.r", "low"), F.least(F.col("o.r") + F.col("o.len"), "high") - 1)))
    rows = rows.withColumn("qpos", F.col("o.q") + F.col("pos") - F.col("o.r")).withColumn("quality", quality_at(F.col("qpos")))
    around = F.substr("padded", (F.col("qpos") + 1).cast("int"), F.lit(2 * KMER_HALF)).cast("string")
    rows = rows.select("chrom", "bin", "pos", "ref_start", "qname", "flag", "mapq", "quality", (F.instr(F.lit("MIDNSHP=X"), F.col("o.op")) - 1).alias("cigar_type"), around.alias("kmer"), F.substr(around, F.lit(KMER_HALF + 1), F.lit(1)).alias("base"))
    if options.one_of_overlapping_mates:
        rows = rows.withColumn("quality", mated_quality())
    rows = rows.where(F.col("quality") >= options.min_base_quality)
    column = Window.partitionBy("chrom", "bin", "pos").orderBy("ref_start", "qname", "flag")
    rows = rows.withColumn("row_idx", F.row_number().over(column) - 1).where(F.col("row_idx") < options.max_depth)
    rows = rows.select("chrom", "bin", "pos", "row_idx", has_flag(PAIRED).alias("is_paired"), has_flag(PROPER).alias("is_proper_pair"), "mapq", "cigar_type", "base", "kmer")
    if clips is not None:
        of_bin = clips.groupBy("chrom", F.floor(F.col("pos") / PILEUP_BIN).alias("bin")).agg(F.map_from_entries(F.collect_list(F.struct("pos", "clip"))).alias("clips"))  # at most PILEUP_BIN entries
        rows = rows.join(of_bin, ["chrom", "bin"], "left").withColumn("clip", F.coalesce(F.try_element_at("clips", F.col("pos")), F.lit(0))).drop("clips")
    places = windows.where(F.col("end") > F.col("start")).select("window_id", "chrom", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / PILEUP_BIN), F.floor((F.col("end") - 1) / PILEUP_BIN))).alias("bin"))
    return rows.join(places, ["chrom", "bin"]).where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))).drop("bin", "end")
