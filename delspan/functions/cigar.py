"""CIGAR strings as arrays of operations, with offsets into the read and the reference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operations that consume the read, and those that consume the reference.
QUERY, REFERENCE = ("M", "I", "S", "=", "X"), ("M", "D", "N", "=", "X")
ALIGNED, GAPS, CLIPS = ("M", "=", "X"), ("D", "N"), ("S", "H")
KMER_HALF = 3


def operations(cigar: Column) -> Column:
    """``array<struct<op, len>>``; empty for ``*``."""
    pattern = F.lit(r"(\d+)([MIDNSHP=X])")
    return F.zip_with(F.regexp_extract_all(cigar, pattern, F.lit(2)), F.regexp_extract_all(cigar, pattern, F.lit(1)), lambda op, n: F.struct(op.alias("op"), n.cast("bigint").alias("len")))


def consumed(ops: Column, kinds: tuple[str, ...]) -> Column:
    """How many positions the operations of these kinds take."""
    return F.aggregate(ops, F.lit(0).cast("bigint"), lambda total, o: total + F.when(o["op"].isin(*kinds), o["len"]).otherwise(F.lit(0)))


def reference_end(start: Column, ops: Column) -> Column:
    """The position after the last aligned one; null where nothing consumes the reference."""
    return start + F.nullif(consumed(ops, REFERENCE), F.lit(0))  # the operations are looked at once


def placed(ops: Column, start: Column) -> Column:
    """``array<struct<op, len, q, r>>``: each operation with the read and reference positions where it begins, in one pass."""
    none = F.array().cast("array<struct<op:string,len:bigint,q:bigint,r:bigint>>")
    step = lambda o, kinds: F.when(o["op"].isin(*kinds), o["len"]).otherwise(F.lit(0))
    return F.aggregate(
        ops,
        F.struct(F.lit(0).cast("bigint").alias("q"), start.alias("r"), none.alias("out")),
        lambda at, o: F.struct((at["q"] + step(o, QUERY)).alias("q"), (at["r"] + step(o, REFERENCE)).alias("r"), F.concat(at["out"], F.array(F.struct(o["op"].alias("op"), o["len"].alias("len"), at["q"].alias("q"), at["r"].alias("r")))).alias("out")),
        lambda at: at["out"],
    )


def operation_at(ops: Column, query_pos: Column) -> Column:
    """Number of the operation (in the order MIDNSHP=X) that covers a read position; -1 if none does."""
    spans = F.filter(placed(ops, F.lit(0).cast("bigint")), lambda o: o["op"].isin(*QUERY) & (o["q"] <= query_pos) & (query_pos < o["q"] + o["len"]))
    return F.coalesce(F.instr(F.lit("MIDNSHP=X"), F.try_element_at(spans, F.lit(1))["op"]) - 1, F.lit(-1))


def kmer(seq: Column, query_pos: Column, half: int = KMER_HALF) -> Column:
    """The bases ``[pos - half, pos + half)`` of the read, padded with N."""
    pad = "N" * half
    return F.substr(F.concat(F.lit(pad), seq, F.lit(pad)), (query_pos + 1).cast("int"), F.lit(2 * half))
