"""DuckDB SQL with the meaning of the queries, from the same derived tables but by other means (theta joins, plain windows)."""

from __future__ import annotations

from ..sources.fixtures import oracle
from ..sources.text_formats import COLUMNS, HEADER

_ALL_REGIONS = """all_regions AS MATERIALIZED (
 SELECT *, CASE WHEN length < 200 THEN 'SMALL' WHEN length < 700 THEN 'MEDIUM' WHEN length < 1000 THEN 'LARGE' ELSE 'VERY_LARGE' END AS size_class FROM (
  SELECT id AS region_id, chrom, pos AS start, coalesce(info_end, pos - 1 + length(ref)) AS "end", coalesce(svtype, CASE WHEN alt = '<DEL>' THEN 'DEL' ELSE 'UNKNOWN' END) AS sv_type,
   abs(coalesce(info_end, pos - 1 + length(ref)) - pos) AS length
  FROM variants WHERE (coalesce(svtype = 'DEL', false) OR alt = '<DEL>') AND regexp_matches(gt, '[1-9]')) x)"""
_REGIONS = _ALL_REGIONS + """,
regions AS MATERIALIZED (SELECT * FROM all_regions WHERE length <= 10000)"""
_ANCHORS = _REGIONS + """,
cut AS (SELECT *, CASE WHEN length > 700 THEN 4 * length // 5 ELSE length END AS size FROM regions),
anchors AS MATERIALIZED (
 SELECT region_id, 'up' AS kind, chrom, start - size - 150 AS start, start - 150 AS "end", 'NON_DEL' AS sv_type FROM cut
 UNION ALL SELECT region_id, 'down', chrom, "end" + 150, "end" + 150 + size, 'NON_DEL' FROM cut)"""


def _tiled(source: str, name: str) -> str:
    return f""",
{name} AS MATERIALIZED (
 SELECT region_id, kind, CASE WHEN kind = 'del' THEN 1 ELSE 0 END AS label, chrom, w AS start, least(w + 50, "end") AS "end", region_id || '_' || kind || '_' || w AS window_id
 FROM (SELECT *, unnest(range(start, "end", 50)) AS w FROM ({source}) s WHERE "end" > start) t
 WHERE least(w + 50, "end") - w >= 25 AND w >= 0)"""


_DEL = "SELECT region_id, 'del' AS kind, chrom, start, \"end\" FROM regions"
_WINDOWS = _ANCHORS + _tiled(_DEL + ' UNION ALL SELECT region_id, kind, chrom, start, "end" FROM anchors', "windows")
_DIGITS, _LETTERS = r"regexp_extract_all(cigar, '(\d+)([MIDNSHP=X])', 1)", r"regexp_extract_all(cigar, '(\d+)([MIDNSHP=X])', 2)"


def _ops(table: str = "reads") -> str:
    return f"""ops AS MATERIALIZED (
 SELECT qname, k, op, n, last, q, ref_start + r AS r FROM (
  SELECT *, max(k) OVER (PARTITION BY qname) AS last,
   CAST(coalesce(sum(CASE WHEN op IN ('M','I','S','=','X') THEN n ELSE 0 END) OVER w, 0) AS BIGINT) AS q, CAST(coalesce(sum(CASE WHEN op IN ('M','D','N','=','X') THEN n ELSE 0 END) OVER w, 0) AS BIGINT) AS r
  FROM (SELECT qname, ref_start, unnest({_LETTERS}) AS op, CAST(unnest({_DIGITS}) AS BIGINT) AS n, unnest(range(len({_DIGITS}))) AS k FROM {table}) x
  WINDOW w AS (PARTITION BY qname ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) y),
rd AS MATERIALIZED (
 SELECT a.*, ref_start + nullif(b.len, 0) AS ref_end, b.first_op, b.last_op, b.query_length FROM {table} a JOIN (
  SELECT qname, CAST(sum(CASE WHEN op IN ('M','D','N','=','X') THEN n ELSE 0 END) AS BIGINT) AS len, CAST(sum(CASE WHEN op IN ('M','I','S','=','X') THEN n ELSE 0 END) AS BIGINT) AS query_length,
   min(op) FILTER (k = 0) AS first_op, min(op) FILTER (k = last) AS last_op FROM ops GROUP BY qname) b USING (qname))"""


_PAIRS = """,
pairs AS MATERIALIZED (SELECT w.window_id, w.start, w."end", r.* FROM rd r JOIN windows w ON r.chrom = w.chrom AND r.ref_start < w."end" AND r.ref_end > w.start)"""
_CLIPS = """,
clips AS MATERIALIZED (
 SELECT chrom, pos, count(*) AS clip FROM (
  SELECT chrom, ref_start AS pos FROM rd WHERE first_op IN ('S','H') UNION ALL SELECT chrom, ref_end - 1 FROM rd WHERE last_op IN ('S','H') AND ref_end IS NOT NULL) x GROUP BY chrom, pos)"""
_DEPTH = """,
bases AS (
 SELECT chrom, pos, upper(substr(seq, CAST(q + pos - r + 1 AS INT), 1)) AS base, ascii(substr(qual, CAST(q + pos - r + 1 AS INT), 1)) - 33 AS quality
 FROM (SELECT rd.chrom, seq, qual, q, r, unnest(range(r, r + n)) AS pos FROM rd JOIN ops USING (qname) WHERE op IN ('M','=','X') AND flag & 1796 = 0) x),
depth AS MATERIALIZED (
 SELECT chrom, pos, count(*) AS depth, count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c, count(*) FILTER (base = 'G') AS g, count(*) FILTER (base = 'T') AS t
 FROM bases WHERE quality >= 15 AND base IN ('A','C','G','T') GROUP BY chrom, pos)"""
_PILEUP = _PAIRS + """,
spread AS (
 SELECT window_id, start, chrom, ref_start, qname, flag, mapq, seq, qual, op, q, r, unnest(range(greatest(r, start), least(r + n, "end"))) AS pos
 FROM pairs JOIN ops USING (qname) WHERE flag & 1796 = 0 AND NOT (flag & 1 = 1 AND flag & 2 = 0) AND op IN ('M','=','X') AND r < "end" AND r + n > start),
pileup AS MATERIALIZED (
 SELECT window_id, start, chrom, pos, row_number() OVER (PARTITION BY window_id, pos ORDER BY ref_start, qname, flag) - 1 AS row_idx, flag & 1 = 1 AS is_paired, flag & 2 = 2 AS is_proper_pair, mapq,
  CASE op WHEN 'M' THEN 0 WHEN '=' THEN 7 ELSE 8 END AS cigar_type, substr(seq, CAST(q + pos - r + 1 AS INT), 1) AS base, substr('NNN' || seq || 'NNN', CAST(q + pos - r + 1 AS INT), 6) AS kmer
 FROM spread WHERE ascii(substr(qual, CAST(q + pos - r + 1 AS INT), 1)) - 33 >= 13)"""


def _cells(r: str, g: str, b: str, join: str = "") -> str:
    shade = lambda c: f"least(255, greatest(0, least(255, {c} + off) + clip))"
    return f""",
coloured AS (
 SELECT p.*, coalesce(c.clip, 0) AS clip, {r} AS r0, {g} AS g0, {b} AS b0,
  CASE WHEN is_paired AND is_proper_pair AND mapq >= 20 AND cigar_type <> 4 THEN 0 ELSE 50 + 10 * (8 * (NOT is_paired)::INT + 4 * (NOT is_proper_pair)::INT + 2 * (mapq < 20)::INT + (cigar_type = 4)::INT) END AS off
 FROM pileup p LEFT JOIN clips c ON p.chrom = c.chrom AND p.pos = c.pos {join}),
cells AS (
 SELECT window_id, (pos - start) * 5 + 5 AS x0, 5 + row_idx * 5 AS y0, {shade('r0')} AS r, {shade('g0')} AS g, {shade('b0')} AS b FROM coloured)"""


_CELL_SUMS = """SELECT window_id, count(*) AS n, CAST(sum(x0) AS BIGINT) AS x0, CAST(sum(y0) AS BIGINT) AS y0, CAST(sum(x0 + 5) AS BIGINT) AS x1, CAST(sum(y0 + 5) AS BIGINT) AS y1,
 CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b, round(sum((r / 255.0::DOUBLE - 0.485::DOUBLE) / 0.229::DOUBLE), 5) AS normal_r FROM cells GROUP BY window_id"""
_BASE_CELLS = _cells("CASE base WHEN 'A' THEN 255 ELSE 0 END", "CASE base WHEN 'T' THEN 255 ELSE 0 END", "CASE base WHEN 'C' THEN 255 ELSE 0 END")
_KMER_CELLS = """,
palette AS (SELECT kmer, ascii(substr(kmer, 2, 1)) * 7 % 256 AS r, ascii(substr(kmer, 3, 1)) * 11 % 256 AS g, ascii(substr(kmer, 4, 1)) * 13 % 256 AS b
 FROM (SELECT DISTINCT substr(seq, 10, 6) AS kmer FROM reads WHERE substr(seq, 10, 1) = 'A') x),
cells AS (
 SELECT window_id, (pos - start) * 5 + 5 AS x0, 5 + row_idx * 5 AS y0, coalesce(l.r, 0) AS r, coalesce(l.g, 0) AS g, coalesce(l.b, 0) AS b FROM pileup p LEFT JOIN palette l ON l.kmer = p.kmer)"""
_KEPT = ",\nkept AS MATERIALIZED (SELECT * FROM pairs WHERE cigar <> '*' AND seq <> '*' AND flag & 1792 = 0)"
_STATS = """,
stats AS MATERIALIZED (
 SELECT window_id, CASE WHEN count(x) < 2 THEN 0 ELSE avg(x) END AS insert_mean, CASE WHEN count(x) < 2 OR stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS insert_std
 FROM (SELECT window_id, CASE WHEN flag & 1 = 1 AND tlen <> 0 THEN abs(tlen) END AS x FROM kept) s GROUP BY window_id)"""
_TENSOR = _KEPT + _STATS + """,
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY ref_start, qname, flag) AS k FROM kept) x WHERE k <= 100),
spread AS (
 SELECT a.window_id, a.start, a.k, flag, mapq, tlen, seq, qual, first_op, last_op, ref_start, ref_end, insert_mean, insert_std, op, q, r, unnest(range(greatest(r, start), least(r + n, "end"))) AS pos
 FROM ranked a JOIN stats USING (window_id) JOIN ops o ON o.qname = a.qname WHERE op IN ('M','=','X','D','N') AND r < "end" AND r + n > start),
cells AS (
 SELECT *, op IN ('M','=','X') AS al, CASE WHEN op IN ('M','=','X') THEN upper(substr(seq, CAST(q + pos - r + 1 AS INT), 1)) END AS base,
  CASE WHEN op IN ('M','=','X') THEN least((ascii(substr(qual, CAST(q + pos - r + 1 AS INT), 1)) - 33) / 40.0::DOUBLE, 1) ELSE 0 END AS bq FROM spread)"""
_PROFILE = _CLIPS + _DEPTH + """,
spots AS (SELECT region_id, chrom, unnest(range(start - 200, "end" + 200)) AS pos FROM regions WHERE start >= 200 AND "end" > start),
profile AS MATERIALIZED (
 SELECT region_id, s.chrom, s.pos, coalesce(depth, 0) AS depth, coalesce(clip, 0) AS clip FROM spots s LEFT JOIN depth d ON s.chrom = d.chrom AND s.pos = d.pos LEFT JOIN clips c ON s.chrom = c.chrom AND s.pos = c.pos)"""


def _smooth(extra: int = 0) -> str:
    return f""",
smooth AS MATERIALIZED (
 SELECT * FROM (
  SELECT *, quantile_cont(depth, 0.5) OVER (PARTITION BY region_id ORDER BY pos ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS median, count(*) OVER (PARTITION BY region_id ORDER BY pos ROWS BETWEEN 30 PRECEDING AND {30 + extra} FOLLOWING) AS n
  FROM profile) x WHERE n = {61 + extra})"""


_HOLED = _REGIONS + ",\n" + _ops("reads_holed") + _PROFILE
_CONTIGS = """,
whole AS MATERIALIZED (SELECT chrom, upper(string_agg(seq, '' ORDER BY chunk_start)) AS seq FROM contigs GROUP BY chrom)"""
_AROUND = """SELECT {id} AS window_id, substr(c.seq, CAST(greatest((w.start + w."end") // 2 - 1250, 0) + 1 AS INT), CAST(least((w.start + w."end") // 2 + 1250, length(c.seq)) - greatest((w.start + w."end") // 2 - 1250, 0) AS INT)) AS seq
 FROM {table} w JOIN whole c ON w.chrom = c.chrom WHERE least((w.start + w."end") // 2 + 1250, length(c.seq)) > greatest((w.start + w."end") // 2 - 1250, 0)"""
_PRED = "p AS MATERIALIZED (SELECT *, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS pred FROM predictions)"


def _report(by: str = "") -> str:
    """report: one row for each label (and epoch)."""
    cols = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    one = lambda y: f"""SELECT {cols}{y} AS label, count(*) FILTER (label = {y} AND pred = {y}) AS hit, count(*) FILTER (label = {y} AND pred <> {y}) AS missed, count(*) FILTER (label <> {y} AND pred = {y}) AS wrong FROM p {group}"""
    return f""",
report AS MATERIALIZED (
 SELECT {cols}label, coalesce(hit / nullif(hit + wrong, 0), 0)::DOUBLE AS precision, coalesce(hit / nullif(hit + missed, 0), 0)::DOUBLE AS recall, coalesce(2 * hit / nullif(2 * hit + missed + wrong, 0), 0)::DOUBLE AS f1, hit + missed AS support, hit + missed + wrong AS seen
 FROM ({one(0)} UNION ALL {one(1)}) x),
summary AS MATERIALIZED (
 SELECT {cols}coalesce(sum(f1 * support) / nullif(sum(support), 0), 0) AS weighted_f1, coalesce(avg(f1) FILTER (seen > 0), 0) AS macro_f1, coalesce(avg(recall) FILTER (support > 0), 0) AS balanced_accuracy,
  coalesce(sum(recall * support) / nullif(sum(support), 0), 0) * 100 AS accuracy FROM report {group})"""


def _curve(by: str = "") -> str:
    cols, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    return f""",
points AS (SELECT {cols}prob, sum(label) AS dp, count(*) AS dt FROM p GROUP BY {cols}prob),
curve AS MATERIALIZED (
 SELECT *, CAST(sum(dp) OVER w AS DOUBLE) AS tp, CAST(sum(dt) OVER w - sum(dp) OVER w AS DOUBLE) AS fp, CAST(sum(dp) OVER ({part}) AS DOUBLE) AS pos, CAST(sum(dt) OVER ({part}) - sum(dp) OVER ({part}) AS DOUBLE) AS neg
 FROM points WINDOW w AS ({part} ORDER BY prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
steps AS (SELECT *, coalesce(lag(tp) OVER v, 0) AS tp0, coalesce(lag(fp) OVER v, 0) AS fp0 FROM curve WINDOW v AS ({part} ORDER BY prob DESC)),
scores AS MATERIALIZED (
 SELECT {cols}sum((fp / neg - fp0 / neg) * (tp / pos + tp0 / pos) / 2) AS roc_auc, sum((tp / pos - tp0 / pos) * tp / (tp + fp)) AS average_precision FROM steps {f'GROUP BY {by}' if by else ''})"""


_WEIGHTS = """,
weights AS (SELECT label, count(*) AS n, (SELECT count(*) FROM p) / (2.0::DOUBLE * count(*)) AS weight FROM p GROUP BY label)"""
_LOSS = "sum(weight * -ln(greatest(CASE WHEN p.label = 1 THEN prob ELSE 1 - prob END, 1e-12::DOUBLE))) / sum(weight)"
_CALLS = """,
calls AS (SELECT chrom, start, "end", prob AS quality, CASE WHEN prob > 0.7 THEN 'PASS' ELSE 'LowQual' END AS filter_status FROM p WHERE pred = 1 AND start <> 0 AND "end" <> 0)"""
_NONEMPTY = """,
nonempty AS MATERIALIZED (SELECT * FROM windows w WHERE EXISTS (SELECT 1 FROM rd r WHERE r.flag & 1796 = 0 AND r.chrom = w.chrom AND r.ref_start < w."end" AND r.ref_end > w.start))"""
_NAME = r"'^(?:(.*?)_)??(non_del_up|non_del_down|non_del|del)_([^_]+)_(-?\d+)_(\d+)$'"
_CHANNEL = {
    **{f"base_{b.lower()}": f"(base = '{b}')::INT" for b in "ACGT"}, "base_quality": "bq", "mapq": "least(mapq / 60.0::DOUBLE, 1)", "paired": "flag & 1", "proper": "(flag & 2) // 2", "reverse": "(flag & 16) // 16",
    "insert_z": "CASE WHEN flag & 1 = 1 AND tlen <> 0 THEN (abs(tlen) - insert_mean) / insert_std ELSE 0 END", "deletion": "(NOT al)::INT", "clip": "((first_op IN ('S','H') AND pos = ref_start) OR (last_op IN ('S','H') AND pos = ref_end - 1))::INT", "aligned": "al::INT",
}
_COUNT_TRAIN = "CAST(chrom AS INT) BETWEEN 1 AND 11"

_TAB = lambda *parts: " || chr(9) || ".join(parts)
_HEADER = ["##fileformat=VCFv4.3", "##fileDate=20240101", *HEADER, "\t".join([*COLUMNS, "S1"])]

_HASH = lambda what: f"CAST('0x' || substr(md5('seed-42|{what}|' || k), 1, 12) AS BIGINT)"

_AUTOSOMAL = _WINDOWS.replace("WHERE length <= 10000)", "WHERE length <= 10000 AND chrom NOT IN ('X', 'Y'))")
_MATES = """,
spread AS (
 SELECT window_id, start, ref_start, name, flag, seq, qual, q, r, unnest(range(greatest(r, start), least(r + n, "end"))) AS pos
 FROM pairs JOIN ops USING (qname) WHERE flag & 1796 = 0 AND NOT (flag & 1 = 1 AND flag & 2 = 0) AND op IN ('M','=','X') AND r < "end" AND r + n > start),
based AS (SELECT *, substr(seq, CAST(q + pos - r + 1 AS INT), 1) AS base, ascii(substr(qual, CAST(q + pos - r + 1 AS INT), 1)) - 33 AS quality FROM spread),
pairs_of AS (SELECT *, row_number() OVER m AS k, lead(quality) OVER m AS q2, lag(quality) OVER m AS q1, lead(base) OVER m AS b2, lag(base) OVER m AS b1 FROM based WINDOW m AS (PARTITION BY window_id, pos, name ORDER BY ref_start, flag)),
mated AS (
 SELECT window_id, start, pos, base, row_number() OVER (PARTITION BY window_id, pos ORDER BY ref_start, name, flag) - 1 AS row_idx FROM pairs_of
 WHERE CASE WHEN flag & 1 = 0 OR (k % 2 = 1 AND q2 IS NULL) THEN quality WHEN k % 2 = 1 AND base = b2 THEN least(quality + q2, 200) WHEN k % 2 = 1 AND quality >= q2 THEN quality * 4 // 5
  WHEN k % 2 = 0 AND base <> b1 AND quality > q1 THEN quality * 4 // 5 ELSE 0 END >= 13)"""

ORACLES = {
    "regions_by_overlap": oracle("""SELECT region_id, coalesce(n_regions, 0) AS n_regions, coalesce(n_reads, 0) AS n_reads, CAST(coalesce(mapq_sum, 0) AS BIGINT) AS mapq_sum FROM all_regions
 LEFT JOIN (SELECT a.region_id, count(*) AS n_regions FROM all_regions a JOIN all_regions b ON a.chrom = b.chrom AND a.start < b."end" AND a."end" > b.start AND a.region_id <> b.region_id WHERE a."end" > a.start AND b."end" > b.start GROUP BY a.region_id) x USING (region_id)
 LEFT JOIN (SELECT w.region_id, count(*) AS n_reads, sum(mapq) AS mapq_sum FROM all_regions w JOIN rd r ON r.chrom = w.chrom AND r.ref_start < w."end" AND r.ref_end > w.start WHERE w."end" > w.start GROUP BY w.region_id) y USING (region_id)""", "reads", "variants", then=_ALL_REGIONS + ",\n" + _ops()),
    "pileup_mates": oracle("""SELECT window_id, count(*) AS n, CAST(sum((pos - start) * (row_idx + 1)) AS BIGINT) AS place_sum, count(*) FILTER (base = 'A') AS n_a, count(*) FILTER (base = 'C') AS n_c, count(*) FILTER (base = 'G') AS n_g, count(*) FILTER (base = 'T') AS n_t
 FROM mated GROUP BY window_id""", "reads_mated", "variants", then=_WINDOWS + ",\nreads_named AS MATERIALIZED (SELECT qname || '/' || which AS qname, qname AS name, flag, chrom, ref_start, cigar, seq, qual FROM reads_mated),\n" + _ops("reads_named") + _PAIRS + _MATES),
    "image_job": oracle(_CELL_SUMS, "reads", "variants", then=_AUTOSOMAL + ",\n" + _ops() + _CLIPS + _PILEUP + _BASE_CELLS),
    "dataset_job": oracle(f"""SELECT c.window_id, c.chrom, c.start, c."end", c.label, CASE WHEN {_COUNT_TRAIN.replace('chrom', 'c.chrom')} THEN 'train' ELSE 'validation' END AS split, base_a, mapq, deletion FROM chosen c JOIN m USING (window_id)
 WHERE place <= CASE kind WHEN 'del' THEN 20 ELSE 10 END""", "reads", "variants", then=_AUTOSOMAL + ",\n" + _ops() + _PAIRS + _TENSOR + """,
equal AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('seed-42|' || window_id), window_id) AS rank FROM windows) x WHERE rank <= (SELECT min(n) FROM (SELECT count(*) AS n FROM windows GROUP BY label) y)),
m AS MATERIALIZED (SELECT window_id, """ + ", ".join(f"round(coalesce(CAST(sum({_CHANNEL[c]}) AS DOUBLE), 0) / 5000 + 1e-10::DOUBLE, 6) + 0.0::DOUBLE AS {c}" for c in ("base_a", "mapq", "deletion")) + """ FROM cells GROUP BY window_id),
chosen AS (SELECT *, row_number() OVER (PARTITION BY chrom, kind ORDER BY md5('seed-42|' || region_id), region_id, start) AS place FROM equal WHERE window_id IN (SELECT window_id FROM m))"""),
    "calling_job": oracle("""SELECT chrom, start, "end", 'DEL' AS sv_type, "end" - start AS length, CASE WHEN "end" - start < 200 THEN 'SMALL' WHEN "end" - start < 700 THEN 'MEDIUM' WHEN "end" - start < 1000 THEN 'LARGE' ELSE 'VERY_LARGE' END AS size_class FROM (
 SELECT chrom, min(start) AS start, max("end") AS "end", round(avg(prob), 9) AS quality FROM (
  SELECT *, sum(CASE WHEN start > seen THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end") AS island FROM (
   SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM p WHERE pred = 1) x) y GROUP BY chrom, island) z WHERE quality >= 0.6""", "predictions", then=_PRED),
    "dataset_rewritten": oracle(f"""SELECT CASE WHEN {_COUNT_TRAIN} THEN 'train' ELSE 'validation' END AS split, label, CASE WHEN start % 2 = 0 THEN 2 ELSE 1 END AS version, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts
 FROM (SELECT DISTINCT label, chrom, start, "end" FROM windows WHERE chrom NOT IN ('X', 'Y')) x WHERE start % 3 > 0 OR start % 2 = 0 GROUP BY ALL""", "variants", then=_WINDOWS),
    "resampled_classes": oracle("SELECT p.window_id, p.label FROM draws d JOIN placed p ON p.label = d.label AND p.place = 1 + d.h % d.size", "predictions", then=f"""placed AS (
 SELECT window_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('seed-42|' || window_id), window_id) AS place, count(*) OVER (PARTITION BY label) AS size FROM predictions),
sizes AS (SELECT DISTINCT label, size FROM placed),
draws AS (SELECT s.label, s.size, {_HASH('row')} AS h FROM range((SELECT count(*) FROM predictions)) r(k) JOIN sizes s ON s.label = (SELECT list(label ORDER BY label) FROM sizes)[1 + {_HASH('label')} % (SELECT count(*) FROM sizes)])"""),
    "variants_from_text": oracle("""SELECT chrom, pos, id, ref, alt, svtype, info_end, gt,
 CASE WHEN carried THEN coalesce(info_end, pos - 1 + length(ref)) END AS "end", CASE WHEN carried THEN coalesce(svtype, 'DEL') END AS sv_type
 FROM (SELECT *, (coalesce(svtype = 'DEL', false) OR alt = '<DEL>') AND regexp_matches(gt, '[1-9]') AS carried FROM variants) x""", "variants"),
    "variants_from_source": oracle("SELECT chrom, pos, id, ref, alt, svtype, info_end, gt FROM variants WHERE chrom IN ('1', '2', 'X') AND pos >= 1000", "variants"),
    "alignments_from_source": oracle("SELECT qname, CAST(flag AS INT) AS flag, chrom, ref_start + 1 AS pos, CAST(mapq AS BIGINT) AS mapq, cigar, CAST(tlen AS BIGINT) AS tlen, seq, qual FROM reads WHERE ref_start >= 600", "reads"),
    "loaded_records": oracle("""SELECT reason, chrom, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(count(*)) OVER () AS BIGINT) AS read, CAST(sum(CASE WHEN reason <> '' THEN count(*) ELSE 0 END) OVER () AS BIGINT) AS rejected
FROM (SELECT reason, CASE WHEN reason = '' THEN chrom ELSE '' END AS chrom,
 CASE reason WHEN 'fields' THEN length(concat_ws('|', chrom, id)) WHEN 'position' THEN length(concat_ws('|', chrom, 'x', id, ref, alt, '.', 'PASS', '.')) END AS chars
 FROM (SELECT *, CASE WHEN CAST(id AS BIGINT) % 101 = 0 THEN 'fields' WHEN CAST(id AS BIGINT) % 89 = 0 THEN 'position' ELSE '' END AS reason FROM variants) x) y GROUP BY 1, 2""", "variants"),
    "alignments_from_text": oracle("SELECT qname, CAST(flag AS INT) AS flag, chrom, ref_start, CAST(mapq AS BIGINT) AS mapq, cigar, CAST(tlen AS BIGINT) AS tlen, seq, qual FROM reads", "reads"),
    "contigs_from_header": oracle("SELECT chrom AS contig, max(chunk_start + length(seq)) AS length, 0 AS more FROM contigs GROUP BY chrom", "contigs"),
    "reference_from_text": oracle("SELECT chrom, chunk_start - min(chunk_start) OVER (PARTITION BY chrom) AS chunk_start, upper(seq) AS seq FROM contigs", "contigs"),
    "dataset_by_split": oracle(f'''SELECT chrom, label, count(*) AS n, min(start) AS first, max("end") AS last FROM (SELECT DISTINCT label, chrom, start, "end" FROM windows WHERE chrom NOT IN ('X', 'Y') AND {_COUNT_TRAIN}) x GROUP BY chrom, label''', "variants", then=_WINDOWS),
    "metrics_as_text": oracle("SELECT epoch, round(weighted_f1, 9) AS weighted_f1, round(accuracy, 9) AS accuracy FROM summary", "predictions", then=_PRED + _report("epoch")),
    "call_file": oracle("SELECT CAST(row_number() OVER (ORDER BY part, chrom, start, k) AS INT) AS k, line FROM (SELECT 0 AS part, unnest(range(" + str(len(_HEADER)) + ")) AS k, '' AS chrom, 0 AS start, unnest([" + ", ".join("'" + x + "'" for x in _HEADER) + """]) AS line
 UNION ALL SELECT 1, 0, chrom, start, """ + _TAB("chrom", "start", "'.'", "'N'", "'<DEL>'", "CAST(trunc(quality * 100) AS INT)", "filter_status", "'SVTYPE=DEL;END=' || \"end\" || ';SVLEN=-' || abs(\"end\" - start)", "'GT'", "'0/1'") + " FROM calls WHERE quality >= 0.6) x", "predictions", then=_PRED + _CALLS),
    "tensor_cells": oracle("SELECT CAST(k - 1 AS INT) AS row_idx, pos - start AS col_idx, count(*) AS n, " + ", ".join(f"round(CAST(sum({x}) AS DOUBLE), 4) + 0.0::DOUBLE AS {c}" for c, x in _CHANNEL.items()) + " FROM cells GROUP BY 1, 2", "reads", "variants", then=_WINDOWS + ",\n" + _ops() + _PAIRS + _TENSOR),
    "deletion_variants": oracle('SELECT region_id, chrom, start, "end", sv_type, length, size_class FROM all_regions', "variants", then=_ALL_REGIONS),
    "all_variant_types": oracle("""SELECT sv_type, CASE WHEN len < 200 THEN 'SMALL' WHEN len < 700 THEN 'MEDIUM' WHEN len < 1000 THEN 'LARGE' ELSE 'VERY_LARGE' END AS size_class, count(*) AS n, CAST(sum(len) AS BIGINT) AS total
 FROM (SELECT coalesce(svtype, CASE WHEN alt = '<DEL>' THEN 'DEL' ELSE 'UNKNOWN' END) AS sv_type, abs(coalesce(info_end, pos - 1 + length(ref)) - pos) AS len FROM variants) x GROUP BY 1, 2""", "variants"),
    "size_class_counts": oracle("SELECT size_class, count(*) AS n FROM all_regions GROUP BY size_class", "variants", then=_ALL_REGIONS),
    "region_filters": oracle("SELECT chrom, count(*) AS n, CAST(sum(length) AS BIGINT) AS total FROM all_regions WHERE size_class <> 'VERY_LARGE' AND length <= 900 AND chrom NOT IN ('X', 'Y') GROUP BY chrom", "variants", then=_ALL_REGIONS),
    "excluded_chromosomes": oracle("SELECT count(*) FILTER (chrom IN ('X', 'Y')) AS excluded, count(*) FILTER (chrom NOT IN ('X', 'Y')) AS kept FROM all_regions", "variants", then=_ALL_REGIONS),
    "anchor_regions": oracle("SELECT * FROM anchors", "variants", then=_ANCHORS),
    "windows_tiled": oracle("SELECT * FROM windows", "variants", then=_WINDOWS),
    "dataset_rollup": oracle("SELECT chrom, kind, count(*) AS n, CAST(grouping_id(chrom, kind) AS INT) AS level FROM windows GROUP BY ROLLUP (chrom, kind)", "variants", then=_WINDOWS),
    "dataset_keys": oracle('SELECT label, count(*) AS n_windows, count(DISTINCT (chrom, start, "end")) AS n_keys FROM windows GROUP BY label', "variants", then=_WINDOWS),
    "split_windows": oracle(f"SELECT CASE WHEN {_COUNT_TRAIN} THEN 'train' ELSE 'validation' END AS split, label, count(*) AS n FROM windows WHERE chrom NOT IN ('X', 'Y') GROUP BY 1, 2", "variants", then=_WINDOWS),
    "class_weights": oracle("SELECT label, count(*) AS n, (SELECT count(*) FROM windows) / (2.0::DOUBLE * count(*)) AS weight FROM windows GROUP BY label", "variants", then=_WINDOWS),
    "cigar_ref_end": oracle("SELECT qname, ref_end, query_length FROM rd", "reads", then=_ops()),
    "cigar_op_at_query": oracle("""SELECT qname, coalesce((SELECT min(instr('MIDNSHP=X', op)) - 1 FROM ops o WHERE o.qname = rd.qname AND op IN ('M','I','S','=','X') AND q <= mapq + 10 AND mapq + 10 < q + n), -1)::INT AS op FROM rd""", "reads", then=_ops()),
    "read_kmers": oracle("SELECT qname, mapq AS at, substr('NNN' || seq || 'NNN', CAST(mapq + 1 AS INT), 6) AS kmer FROM reads", "reads"),
    "read_preview": oracle("SELECT qname, chrom, ref_start, cigar FROM reads ORDER BY chrom, ref_start, qname LIMIT 5", "reads"),
    "contig_lengths": oracle("SELECT chrom, max(chunk_start + length(seq)) AS length FROM contigs GROUP BY chrom", "contigs"),
    "aligned_pairs_summary": oracle("""SELECT chrom, count(*) AS n, count(*) FILTER (op IN ('D','N')) AS gaps, CAST(sum(qpos) AS BIGINT) AS qpos_sum, CAST(sum(pos) AS BIGINT) AS pos_sum, CAST(sum(ascii(substr(qual, CAST(qpos + 1 AS INT), 1)) - 33) AS BIGINT) AS quality_sum,
 count(*) FILTER (upper(substr(seq, CAST(qpos + 1 AS INT), 1)) = 'A') AS n_a, count(*) FILTER (upper(substr(seq, CAST(qpos + 1 AS INT), 1)) = 'C') AS n_c, count(*) FILTER (upper(substr(seq, CAST(qpos + 1 AS INT), 1)) = 'G') AS n_g, count(*) FILTER (upper(substr(seq, CAST(qpos + 1 AS INT), 1)) = 'T') AS n_t
 FROM (SELECT chrom, seq, qual, op, pos, CASE WHEN op IN ('M','=','X') THEN q + pos - r END AS qpos FROM (SELECT chrom, seq, qual, op, q, r, unnest(range(r, r + n)) AS pos FROM rd JOIN ops USING (qname) WHERE op IN ('M','=','X','D','N')) x) y GROUP BY chrom""", "reads", then=_ops()),
    "depth_by_position": oracle("SELECT * FROM depth", "reads", then=_ops() + _DEPTH),
    "clip_counts": oracle("SELECT * FROM clips", "reads", then=_ops() + _CLIPS),
    "reads_per_window": oracle(r"SELECT window_id, count(*) AS n_reads, CAST(sum(mapq) AS BIGINT) AS mapq_sum, count(*) FILTER (regexp_matches(cigar, '[SH]')) AS clipped FROM pairs GROUP BY window_id", "reads", "variants", then=_WINDOWS + ",\n" + _ops() + _PAIRS),
    "stored_reads_per_window": oracle(r"SELECT window_id, count(*) AS n_reads, CAST(sum(mapq) AS BIGINT) AS mapq_sum, count(*) FILTER (regexp_matches(cigar, '[SH]')) AS clipped FROM pairs GROUP BY window_id", "reads", "variants", then=_WINDOWS + ",\n" + _ops() + _PAIRS),
    "reads_rollup": oracle("""SELECT chrom, CAST(label AS VARCHAR) AS label, count(*) AS windows, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_reads, round(CAST(sum(m) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 9) AS mean_mapq
 FROM windows LEFT JOIN (SELECT window_id, count(*) AS n, sum(mapq) AS m FROM pairs GROUP BY window_id) x USING (window_id) GROUP BY ROLLUP (chrom, label)""", "reads", "variants", then=_WINDOWS + ",\n" + _ops() + _PAIRS),
    "window_clips": oracle("""SELECT window_id, CAST(sum(coalesce(clip, 0)) AS BIGINT) AS clips, max(coalesce(clip, 0)) AS most, count(clip) AS positions
 FROM (SELECT window_id, chrom, unnest(range(start, "end")) AS pos FROM windows) w LEFT JOIN clips c ON w.chrom = c.chrom AND w.pos = c.pos GROUP BY window_id""", "reads", "variants", then=_WINDOWS + ",\n" + _ops() + _CLIPS),
    "nonempty_windows": oracle("SELECT window_id, label FROM nonempty", "reads", "variants", then=_WINDOWS + ",\n" + _ops() + _NONEMPTY),
    "generation_summary": oracle("SELECT label, count(*) AS seen, count(s) AS saved, count(*) - count(s) AS skipped FROM windows LEFT JOIN (SELECT window_id, 1 AS s FROM nonempty) x USING (window_id) GROUP BY label", "reads", "variants", then=_WINDOWS + ",\n" + _ops() + _NONEMPTY),
    "window_quota": oracle("""SELECT window_id, chrom, kind FROM (SELECT *, row_number() OVER (PARTITION BY chrom, kind ORDER BY md5('seed-42|' || region_id), region_id, start) AS k FROM nonempty) x
 WHERE k <= CASE kind WHEN 'del' THEN 20 ELSE 10 END""", "reads", "variants", then=_WINDOWS + ",\n" + _ops() + _NONEMPTY),
    "balanced_windows": oracle("""SELECT window_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('seed-42|' || window_id), window_id) AS k FROM windows) x
 WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM windows GROUP BY label) y)""", "variants", then=_WINDOWS),
    "first_windows": oracle('SELECT window_id, chrom, start, "end" FROM windows ORDER BY chrom, start, window_id LIMIT 100', "variants", then=_WINDOWS),
    "shuffled_regions": oracle("SELECT region_id, chrom, CAST(row_number() OVER (PARTITION BY chrom ORDER BY md5('seed-42|' || region_id), region_id) AS INT) AS place FROM regions", "variants", then=_REGIONS),
    "pileup_columns": oracle("""SELECT window_id, count(*) AS n, CAST(max(row_idx) AS INT) AS rows, CAST(sum(mapq) AS BIGINT) AS mapq_sum, CAST(sum((pos - start) * (row_idx + 1)) AS BIGINT) AS place_sum, count(*) FILTER (base = 'A') AS n_a, count(*) FILTER (is_proper_pair) AS proper,
 count(*) FILTER (cigar_type = 0) AS matches, count(*) FILTER (kmer LIKE 'N%') AS padded FROM pileup GROUP BY window_id""", "reads", "variants", then=_WINDOWS + ",\n" + _ops() + _PILEUP),
    "image_cells": oracle(_CELL_SUMS, "reads", "variants", then=_WINDOWS + ",\n" + _ops() + _CLIPS + _PILEUP + _BASE_CELLS),
    "image_cells_kmer": oracle(_CELL_SUMS, "reads", "variants", then=_WINDOWS + ",\n" + _ops() + _PILEUP + _KMER_CELLS),
    "insert_size_stats": oracle("SELECT window_id, round(insert_mean, 6) AS insert_mean, round(insert_std, 6) AS insert_std FROM stats", "reads", "variants", then=_WINDOWS + ",\n" + _ops() + _PAIRS + _KEPT + _STATS),
    "tensor_channel_means": oracle("SELECT window_id, " + ", ".join(f"round(coalesce(CAST(sum({x}) AS DOUBLE), 0) / 5000 + 1e-10::DOUBLE, 6) + 0.0::DOUBLE AS {c}" for c, x in _CHANNEL.items()) + " FROM cells GROUP BY window_id", "reads", "variants", then=_WINDOWS + ",\n" + _ops() + _PAIRS + _TENSOR),
    "region_profile": oracle("SELECT region_id, count(*) AS n, CAST(sum(depth) AS BIGINT) AS depth_sum, max(depth) AS depth_max, CAST(sum(clip) AS BIGINT) AS clip_sum FROM profile GROUP BY region_id", "reads_holed", "variants", then=_HOLED),
    "smoothed_depth": oracle("SELECT region_id, count(*) AS n, sum(median) AS median_sum, max(median) AS median_max, min(pos) AS first, max(pos) AS last FROM smooth GROUP BY region_id", "reads_holed", "variants", then=_HOLED + _smooth()),
    "smoothed_for_detection": oracle("SELECT region_id, count(*) AS n, sum(median) AS median_sum, max(pos) AS last FROM smooth GROUP BY region_id", "reads_holed", "variants", then=_HOLED + _smooth(1)),
    "cluster_decision": oracle("""SELECT region_id, l1 AS "left", r1 AS "right", e2 AS threshold FROM (
  SELECT region_id, count(*) AS n, min(l) AS first, max(r) AS last, max(m) FILTER (k = 1) AS m1, max(m) FILTER (k = 2) AS m2, max(m) FILTER (k = 3) AS m3, max(e) FILTER (k = 2) AS e2, max(l) FILTER (k = 1) AS l1, max(r) FILTER (k = 1) AS r1
  FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY m, cluster DESC) AS k FROM (
   SELECT region_id, cluster, CAST(floor(avg(5 * median) / 5) AS BIGINT) AS m, CAST(floor(min(5 * median) / 5) AS BIGINT) AS e, min(pos) AS l, max(pos) AS r FROM (SELECT *, ntile(3) OVER (PARTITION BY region_id ORDER BY pos) AS cluster FROM smooth) a GROUP BY region_id, cluster) b) c
  GROUP BY region_id) d WHERE n = 3 AND m1 < floor(4 * m2 / 5) AND m1 < floor(4 * m3 / 5) AND l1 > first AND r1 < last""", "reads_holed", "variants", then=_HOLED + _smooth()),
    "boundary_walk": oracle("""SELECT region_id, coalesce(max(pos) FILTER (pos <= s AND depth > 3), min(pos)) AS start, coalesce(min(pos) FILTER (pos >= e AND depth > 3), max(pos)) AS "end"
 FROM profile JOIN (SELECT region_id, start AS s, "end" - 1 AS e FROM regions) c USING (region_id) GROUP BY region_id""", "reads_holed", "variants", then=_HOLED),
    "context_sequence": oracle("SELECT window_id, CAST(length(seq) AS INT) AS bases, md5(seq) AS seq_md5 FROM (" + _AROUND.format(id="window_id", table="windows") + ") x", "contigs", "variants", then=_WINDOWS + _CONTIGS),
    "kmer_frequencies": oracle("""SELECT window_id AS region_id, round(CAST(CAST(a AS FLOAT) / CAST(n AS FLOAT) AS DOUBLE), 6) AS aaa, round(CAST(CAST(c AS FLOAT) / CAST(n AS FLOAT) AS DOUBLE), 6) AS cgt, round(CAST(CAST(t AS FLOAT) / CAST(n AS FLOAT) AS DOUBLE), 6) AS ttt FROM (
  SELECT window_id, greatest(count(*) FILTER (k NOT LIKE '%N%'), 1) AS n, count(*) FILTER (k = 'AAA') AS a, count(*) FILTER (k = 'CGT') AS c, count(*) FILTER (k = 'TTT') AS t
  FROM (SELECT window_id, substr(seq, CAST(i AS INT), 3) AS k FROM (SELECT window_id, seq, unnest(range(1, length(seq) - 1)) AS i FROM (""" + _AROUND.format(id="region_id", table="regions") + ") x) y) z GROUP BY window_id) u", "contigs", "variants", then=_REGIONS + _CONTIGS),
    "embedding_mean": oracle(f"SELECT CAST(i AS INT) AS i, round(avg(x), 7) AS mean FROM (SELECT unnest(range(len(context_raw))) AS i, CAST(unnest(context_raw) AS DOUBLE) AS x FROM contexts WHERE {_COUNT_TRAIN}) a GROUP BY i", "contexts"),
    "embedding_covariance": oracle("SELECT CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(avg(a.x * b.x) - avg(a.x) * avg(b.x), 7) + 0.0::DOUBLE AS cov FROM v a JOIN v b ON a.window_id = b.window_id AND a.i <= b.i GROUP BY a.i, b.i", "contexts", then=f"v AS MATERIALIZED (SELECT window_id, unnest(range(len(context_raw))) AS i, CAST(unnest(context_raw) AS DOUBLE) AS x FROM contexts WHERE {_COUNT_TRAIN})"),
    "windows_with_context": oracle("SELECT p.chrom, count(*) AS n, count(context_raw) AS with_context FROM predictions p LEFT JOIN contexts c ON p.window_id = c.window_id GROUP BY p.chrom", "predictions", "contexts"),
    "confusion_matrix": oracle("SELECT l AS label, q AS pred, count(p.prob) AS n FROM (SELECT * FROM (VALUES (0), (1)) a(l), (VALUES (0), (1)) b(q)) g LEFT JOIN p ON p.label = l AND p.pred = q GROUP BY l, q", "predictions", then=_PRED),
    "class_report": oracle("SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM report", "predictions", then=_PRED + _report()),
    "f1_summary": oracle("SELECT round(weighted_f1, 9) AS weighted_f1, round(macro_f1, 9) AS macro_f1, round(balanced_accuracy, 9) AS balanced_accuracy, round(accuracy, 9) AS accuracy FROM summary", "predictions", then=_PRED + _report()),
    "roc_curve": oracle("""SELECT prob, fp / neg AS fpr, tp / pos AS tpr FROM (SELECT *, lead(dp) OVER w AS dp1, lead(dt) OVER w AS dt1, row_number() OVER w AS k FROM curve WINDOW w AS (ORDER BY prob DESC)) x
 WHERE k = 1 OR dp1 IS NULL OR dp1 <> dp OR dt1 <> dt UNION ALL SELECT NULL, 0, 0""", "predictions", then=_PRED + _curve()),
    "pr_curve": oracle("SELECT prob, tp / (tp + fp) AS precision, tp / pos AS recall FROM curve UNION ALL SELECT NULL, 1, 0", "predictions", then=_PRED + _curve()),
    "ranking_scores": oracle("SELECT round(roc_auc, 9) AS roc_auc, round(average_precision, 9) AS average_precision FROM scores", "predictions", then=_PRED + _curve()),
    "weighted_log_loss": oracle(f"SELECT round({_LOSS}, 9) AS loss FROM p JOIN weights USING (label)", "predictions", then=_PRED + _WEIGHTS),
    "epoch_history": oracle(f"""SELECT epoch, round(weighted_f1, 9) AS weighted_f1, round(macro_f1, 9) AS macro_f1, round(balanced_accuracy, 9) AS balanced_accuracy, round(accuracy, 9) AS accuracy, round(roc_auc, 9) AS roc_auc, round(average_precision, 9) AS average_precision, round(loss, 9) AS loss
 FROM summary JOIN scores USING (epoch) JOIN (SELECT epoch, {_LOSS} AS loss FROM p JOIN weights USING (label) GROUP BY epoch) l USING (epoch)""", "predictions", then=_PRED + _report("epoch") + _curve("epoch") + _WEIGHTS),
    "best_epoch": oracle("SELECT epoch, round(weighted_f1, 9) AS weighted_f1 FROM summary WHERE weighted_f1 > 0 ORDER BY summary.weighted_f1 DESC, epoch LIMIT 1", "predictions", then=_PRED + _report("epoch")),
    "saved_epochs": oracle("SELECT epoch, round(weighted_f1, 9) AS weighted_f1 FROM (SELECT *, coalesce(max(weighted_f1) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM summary) x WHERE x.weighted_f1 > b", "predictions", then=_PRED + _report("epoch")),
    "deletion_calls": oracle("SELECT * FROM calls", "predictions", then=_PRED + _CALLS),
    "merged_calls": oracle("""SELECT chrom, min(start) AS start, max("end") AS "end", round(avg(prob), 9) AS mean_prob, max(prob) AS max_prob, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN start > seen THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end") AS island FROM (
   SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM p WHERE pred = 1) x) y GROUP BY chrom, island""", "predictions", then=_PRED),
    "vcf_lines": oracle("""SELECT chrom, start, chrom || chr(9) || start || chr(9) || '.' || chr(9) || 'N' || chr(9) || '<DEL>' || chr(9) || CAST(trunc(quality * 100) AS INT) || chr(9) || filter_status || chr(9) || 'SVTYPE=DEL;END=' || "end" || ';SVLEN=-' || abs("end" - start) || chr(9) || 'GT' || chr(9) || '0/1' AS line
 FROM calls WHERE quality >= 0.6""", "predictions", then=_PRED + _CALLS),
    "window_names": oracle(f"""SELECT window_id, name, nullif(regexp_extract(name, {_NAME}, 1), '') AS sample, regexp_extract(name, {_NAME}, 2) AS kind, regexp_extract(name, {_NAME}, 3) AS chrom, CAST(regexp_extract(name, {_NAME}, 4) AS BIGINT) AS start, CAST(regexp_extract(name, {_NAME}, 5) AS BIGINT) AS "end"
 FROM (SELECT window_id, CASE WHEN start % 3 = 0 THEN 'NA_' || chrom || '_' ELSE '' END || CASE kind WHEN 'del' THEN 'del' ELSE 'non_del_' || kind END || '_' || chrom || '_' || start || '_' || "end" AS name FROM windows) x""", "variants", then=_WINDOWS),
    "softmax_scores": oracle("SELECT window_id, round(1 / (1 + exp(prob * 4 - 2 - (label - prob))), 9) AS prob1, CASE WHEN label - prob > prob * 4 - 2 THEN 1 ELSE 0 END AS pred1 FROM predictions", "predictions"),
    "model_scores": oracle("SELECT window_id, round(1 / (1 + exp(-s)), 6) AS prob, CASE WHEN 1 / (1 + exp(-s)) > 0.5 THEN 1 ELSE 0 END AS pred FROM (SELECT window_id, list_sum(CAST(context_raw AS DOUBLE[])) AS s FROM contexts) x", "contexts"),
}
