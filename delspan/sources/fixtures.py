"""Genomic tables as pure functions of the star-schema test tables.

``SQL[name]`` runs unchanged in Spark and in DuckDB, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

READS = """
WITH a AS (
 SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS INT) AS lq, l_returnflag, l_linestatus,
  concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(l_linenumber AS STRING), CAST(CAST(round(l_extendedprice*100) AS BIGINT) AS STRING)) AS k
 FROM lineitem),
b AS (
 SELECT *, md5(k) AS qname, l_orderkey % 24 + 1 AS cn,
  CASE WHEN l_returnflag='R' THEN '5S' WHEN l_returnflag='A' AND l_linenumber=7 THEN '5H' ELSE '' END AS lclip,
  CASE WHEN l_linestatus='O' AND l_suppkey % 3 = 0 THEN '7S' ELSE '' END AS rclip,
  20 + lq AS m1,
  CASE l_partkey % 11 WHEN 0 THEN '3D' WHEN 1 THEN '2I' WHEN 2 THEN '10N' ELSE '' END AS mid
 FROM a),
c AS (
 SELECT *, concat(lclip, CAST(m1 AS STRING), 'M', mid, CASE WHEN mid='' THEN '' ELSE '30M' END, rclip) AS cigar,
  (CASE WHEN lclip='5S' THEN 5 ELSE 0 END) + m1 + (CASE WHEN mid='2I' THEN 32 WHEN mid='' THEN 0 ELSE 30 END) + (CASE WHEN rclip='7S' THEN 7 ELSE 0 END) AS qlen,
  CASE WHEN l_suppkey % 10 <> 0 THEN 1 ELSE 0 END AS paired
 FROM b)
SELECT qname,
  (paired + CASE WHEN paired=1 AND lq % 4 <> 0 THEN 2 ELSE 0 END + CASE WHEN l_linenumber % 2 = 0 THEN 16 ELSE 0 END
   + CASE WHEN l_partkey % 50 = 7 THEN 256 ELSE 0 END + CASE WHEN l_partkey % 53 = 5 THEN 512 ELSE 0 END
   + CASE WHEN l_partkey % 59 = 3 THEN 1024 ELSE 0 END + CASE WHEN l_partkey % 41 = 2 THEN 2048 ELSE 0 END) AS flag,
  CASE cn WHEN 23 THEN 'X' WHEN 24 THEN 'Y' ELSE CAST(cn AS STRING) END AS chrom,
  l_partkey * 8 + l_linenumber AS ref_start,
  (l_suppkey * 7 + l_linenumber) % 61 AS mapq,
  CASE WHEN l_partkey % 97 = 3 THEN concat(CAST(qlen AS STRING), 'S') ELSE cigar END AS cigar,
  CASE WHEN paired=0 OR l_partkey % 17 = 0 THEN 0 WHEN l_linenumber % 2 = 0 THEN -(l_partkey % 400 + 100) ELSE l_partkey % 400 + 100 END AS tlen,
  substr(translate(concat(qname, md5(concat(k,'b')), md5(concat(k,'c')), md5(concat(k,'d'))), '0123456789abcdef', 'ACGTACGTACGTACGN'), 1, qlen) AS seq,
  substr(translate(concat(md5(concat(k,'q')), md5(concat(k,'r')), md5(concat(k,'s')), md5(concat(k,'t'))), '0123456789abcdef', '#+-.02469;=?BDFJ'), 1, qlen) AS qual
FROM c
"""

VARIANTS = """
WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
  CASE WHEN o_orderkey % 97 = 0 THEN 12000 ELSE 30 + (o_orderkey * 7919) % 1400 END AS len, o_orderkey % 24 + 1 AS cn FROM orders)
SELECT CAST(o_orderkey AS STRING) AS id, CASE cn WHEN 23 THEN 'X' WHEN 24 THEN 'Y' ELSE CAST(cn AS STRING) END AS chrom,
  o_custkey * 10 + 500 AS pos,
  CASE WHEN o_orderkey % 13 = 0 THEN repeat('N', CAST(len + 1 AS INT)) ELSE 'N' END AS ref,
  CASE WHEN o_orderpriority LIKE '1%' THEN '<DEL>' WHEN o_orderpriority LIKE '2%' THEN '<CN0>' ELSE '<DUP>' END AS alt,
  CASE WHEN o_orderpriority LIKE '1%' AND o_orderkey % 7 = 0 THEN NULL WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'DEL' ELSE 'DUP' END AS svtype,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey * 10 + 500 + len END AS info_end,
  CASE o_orderstatus WHEN 'F' THEN '0|1' WHEN 'O' THEN '0|0' ELSE '.|1' END AS gt
FROM a
"""

CONTIGS = """
WITH n AS (SELECT DISTINCT o_orderkey % 24 + 1 AS cn FROM orders), c AS (SELECT CASE cn WHEN 23 THEN 'X' WHEN 24 THEN 'Y' ELSE CAST(cn AS STRING) END AS chrom FROM n)
SELECT chrom, p_partkey * 8 AS chunk_start, substr(translate(md5(concat(chrom, ':', CAST(p_partkey AS STRING))), '0123456789abcdef', 'ACGTacgtACGTACGN'), 1, 8) AS seq
FROM part CROSS JOIN c
"""

PREDICTIONS = """
WITH a AS (SELECT event_id, event_id % 24 + 1 AS cn, CAST(floor(event_id / 24) AS BIGINT) AS wi, CAST(round(value * 100) AS BIGINT) AS v FROM events)
SELECT event_id AS window_id, CASE cn WHEN 23 THEN 'X' WHEN 24 THEN 'Y' ELSE CAST(cn AS STRING) END AS chrom,
  wi * 50 AS start, wi * 50 + 50 AS "end", CAST(v % 1000 AS DOUBLE) / 1000 AS prob,
  CASE WHEN (v * 7 + event_id * 31) % 1000 < v % 1000 THEN 1 ELSE 0 END AS label, CAST(1 + event_id % 5 AS INT) AS epoch
FROM a
"""

CONTEXTS = """
SELECT vec_id AS window_id, CAST(vec_id % 22 + 1 AS STRING) AS chrom, embedding AS context_raw, CASE WHEN label < 5 THEN 0 ELSE 1 END AS label FROM embeddings
"""

READS_HOLED = """
SELECT * FROM reads
WHERE NOT (ref_start < 4600 AND ref_start + 120 > 4000)
  AND NOT (ref_start < 9400 AND ref_start + 120 > 9000)
"""

#: Paired reads and a mate of each that overlaps it; ``which`` is 1 or 2.
READS_MATED = """
SELECT qname, flag, chrom, ref_start, mapq, cigar, tlen, seq, qual, 1 AS which FROM reads
UNION ALL
SELECT qname, flag + 128 AS flag, chrom, ref_start + mapq % 3 * 7 AS ref_start, mapq, cigar, -tlen AS tlen, CASE WHEN mapq % 3 = 0 THEN translate(seq, 'T', 'G') ELSE seq END AS seq, concat(substr(qual, 11), substr(qual, 1, 10)) AS qual, 2 AS which FROM reads WHERE flag % 2 = 1
"""
SQL = {"reads": READS, "variants": VARIANTS, "contigs": CONTIGS, "predictions": PREDICTIONS, "contexts": CONTEXTS}
BASE = ("lineitem", "orders", "part", "events", "embeddings")


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows of a file of few row groups, which would be few tasks, dealt to all cores before anything is derived from them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived tables over the files in ``sf_dir``."""
    if name == "reads_mated":
        return spark.sql(READS_MATED.replace("FROM reads", "FROM {reads}"), reads=table(spark, sf_dir, "reads"))
    if name == "reads_holed":
        return spark.sql(READS_HOLED.replace("FROM reads", "FROM {reads}"), reads=table(spark, sf_dir, "reads"))
    sql = SQL[name].replace('"end"', "`end`")
    used = {t: _dealt(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in BASE if re.search(rf"FROM {t}\b", sql)}
    return spark.sql(re.sub(rf"FROM ({'|'.join(BASE)})\b", r"FROM {\1}", sql), **used)


def oracle(body: str, *names: str, then: str = "") -> str:
    """DuckDB SQL: the derived tables as common table expressions, ``then`` more of them, and ``body``."""
    wanted = [*names]
    derived = {"reads_holed": READS_HOLED, "reads_mated": READS_MATED}
    if derived.keys() & {*wanted} and "reads" not in wanted:
        wanted.insert(0, "reads")
    parts = [f"{n} AS MATERIALIZED ({SQL[n] if n in SQL else derived[n]})" for n in sorted(wanted, key=lambda n: n in derived)]
    parts += [then] if then else []
    return f"WITH {', '.join(parts)}\n{body}" if parts else body
