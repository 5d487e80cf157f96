"""Sequences around windows are dealt by chunks, and embedded where they are."""

import numpy as np

from delspan.operators import context
from delspan.plans import queries as q
from tests.compare import SF


def test_windows_are_not_dealt_by_chromosome(spark):
    """Contigs' lengths may not bring all windows of a chromosome together, whatever the sizes."""
    least = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(least)
    spark.conf.set(least, -1)
    try:
        plan = q.QUERIES["context_sequence"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(least, before)
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 2 and any("BroadcastHashJoin [chrom" in x for x in joins) and any("SortMergeJoin [chrom" in x and ", k" in x for x in joins)


def test_equal_and_short_sequences_are_embedded(spark):
    def make():
        return lambda seq: np.array([len(seq), seq.count("A")], np.float32)

    seqs = spark.createDataFrame([("a", "1", "A" * 12), ("b", "2", "A" * 12), ("c", "1", "ACG"), ("d", "1", None), ("e", "1", "C" * 20)], "window_id string, chrom string, seq string")
    found = context.embeddings(seqs, make, 2)
    assert {r.window_id: (r.chrom, *r.context_raw) for r in found.collect()} == {"a": ("1", 12, 12), "b": ("2", 12, 12), "c": ("1", 0, 0), "d": ("1", 0, 0), "e": ("1", 20, 0)}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
