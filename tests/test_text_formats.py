import random

import pytest
from pyspark.sql import functions as F

from delspan.operators import alignments, tensors, variants
from delspan.sources import text_formats as t

SAM = "\n".join(
    [
        "@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:1\tLN:1000", "@SQ\tSN:X\tLN:500",
        "r1\t99\t1\t11\t60\t5S10M\t=\t111\t120\tNNNNNACGTACGTAC\tIIIIIIIIIIIIIII", "r2\t147\t1\t16\t30\t4M2D6M3S\t=\t11\t-120\tACGTACGTACNNN\t5555555555555",
        "r3\t0\t1\t20\t10\t5H3M2I5M\t*\t0\t0\tACGTTACGTA\tIIIIIIIIII", "r4\t1024\t1\t20\t60\t10M\t*\t0\t0\tACGTACGTAC\tIIIIIIIIII", "r5\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII",
    ]
)
VCF = "\n".join(
    [
        "##fileformat=VCFv4.3", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2",
        "1\t100\ta\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;END=400\tGT\t0|1\t0|0", "1\t900\tb\tN\t<DEL>\t.\tPASS\tEND=1601\tGT:DP\t1/1:7\t./.", "2\t50\tc\tNNNNN\tN\t.\tPASS\tSVTYPE=DEL\tGT\t.|1\t0|1",
        "2\t70\td\tN\t<DUP>\t.\tPASS\tSVTYPE=DUP;END=170\tGT\t0|1\t1|1", "X\t10\te\tN\t<CN0>,<DEL>\t.\tPASS\tSVTYPE=CNV;END=1010\tGT\t0|2\t0|0",
    ]
)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("texts")
    (d / "a.sam").write_text(SAM + "\n")
    (d / "a.vcf").write_text(VCF + "\n")
    (d / "a.fa").write_text(">1 first\nacgtn\nACGTA\n>2\nGGCC\n")
    return d


def test_alignments(spark, files):
    reads = t.read_alignments(spark, f"{files}/a.sam")
    ends = {r.qname: (r.ref_start, r.ref_end) for r in alignments.with_operations(reads).collect()}
    assert ends == {"r1": (10, 20), "r2": (15, 27), "r3": (19, 27), "r4": (19, 29)}
    clips = {r.pos: r.clip for r in alignments.clips(reads).collect()}
    assert clips == {10: 1, 26: 1, 19: 1}
    depth = {r.pos: r.depth for r in alignments.depth(reads).collect()}
    assert depth == {**dict.fromkeys(range(10, 15), 1), **dict.fromkeys(range(15, 20), 2), 20: 1, **dict.fromkeys(range(21, 27), 2)}
    window = spark.createDataFrame([("w", "1", 10, 60)], "window_id string, chrom string, start long, end long")
    stats = tensors.insert_size_stats(tensors.window_reads(reads, window)).first()
    assert (stats.insert_mean, stats.insert_std) == (120.0, 1.0)
    cells = tensors.tensor_cells(reads, window)
    assert cells.agg(F.max(F.abs("insert_z"))).first()[0] == 0.0
    assert cells.where("row_idx = 1 and deletion = 1").agg(F.collect_set("col_idx")).first()[0] in ([9, 10], [10, 9])
    tensor = tensors.dense(cells, max_reads=4).first()
    assert tensor.shape == [13, 4, 50] and len(tensor.tensor) == 13 * 4 * 50
    rows = alignments.pileup(reads, window, alignments.PileupOptions())
    first = rows.where("pos = 10").first()
    assert first.base == "A" and first.kmer == "NNNACG" and first.row_idx == 0


def test_contigs_and_samples(spark, files):
    rows, more = t.alignment_contigs(spark, f"{files}/a.sam")
    assert [(r.contig, r.length) for r in rows.collect()] == [("1", 1000), ("X", 500)] and more == 0
    assert t.sample_alignments(spark, str(files), "a.sa").count() == 4
    with pytest.raises(ValueError, match="no file"):
        t.sample_alignments(spark, str(files), "zzz")
    with pytest.raises(ValueError, match="more than one"):
        t.sample_alignments(spark, str(files), "a")


def test_variants(spark, files):
    regions = {r.region_id: r for r in variants.regions(t.read_variants(spark, f"{files}/a.vcf", "S1"), carriers=True).collect()}
    assert {k: (r.start, r.end, r.length, r.size_class, r.sv_type) for k, r in regions.items()} == {
        "a": (100, 400, 300, "MEDIUM", "DEL"), "b": (900, 1601, 701, "LARGE", "DEL"), "c": (50, 54, 4, "SMALL", "DEL"), "e": (10, 1010, 1000, "VERY_LARGE", "CNV"),
    }
    assert [r.region_id for r in variants.regions(t.read_variants(spark, f"{files}/a.vcf", "S2"), carriers=True).collect()] == ["c"]
    assert variants.regions(t.read_variants(spark, f"{files}/a.vcf"), variant_type="non_deletion").count() == 5  # filters nothing
    assert variants.regions(t.read_variants(spark, f"{files}/a.vcf")).count() == 4  # no sample, no look at genotypes
    with pytest.raises(ValueError, match="S9"):
        t.read_variants(spark, f"{files}/a.vcf", "S9")
    found = {(r.region_id, r.kind): (r.start, r.end) for r in variants.anchors(variants.regions(t.read_variants(spark, f"{files}/a.vcf", "S1"))).collect()}
    assert found[("a", "up")] == (-350, -50) and found[("a", "down")] == (550, 850)
    assert found[("b", "up")] == (190, 750) and found[("b", "down")] == (1751, 2311)
    assert found[("c", "down")] == (204, 208) and found[("e", "up")] == (-940, -140) and found[("e", "down")] == (1160, 1960)


def test_reference(spark, files):
    rows = t.read_reference(spark, f"{files}/a.fa").orderBy("chrom", "chunk_start").collect()
    assert [tuple(r) for r in rows] == [("1", 0, "ACGTN"), ("1", 5, "ACGTA"), ("2", 0, "GGCC")]


def test_reference_in_many_splits(spark, tmp_path):
    rng = random.Random(3)
    text, want = "", []
    for c in "abcdef":
        text, at = f"{text}>{c} about {c}\r\n", 0
        for _ in range(rng.randrange(40)):
            line = "".join(rng.choice("ACGTn") for _ in range(rng.randrange(1, 70)))
            text += line + "\r\n"
            want.append((c, at, line.upper()))
            at += len(line)
    (tmp_path / "r.fa").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    try:
        got = t.read_reference(spark, str(tmp_path / "r.fa")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, got)) == sorted(want)


def test_contigs_over_several_files(spark, tmp_path):
    chunks = [(c, k * 7, "ACGTNac"[: 7 if k < 300 else 3]) for c in ("1", "2", "X") for k in range(301)]
    rows = spark.createDataFrame(chunks, "chrom string, chunk_start long, seq string").repartition(5)
    t.write_reference(rows, str(tmp_path / "r"))
    got = t.read_reference(spark, str(tmp_path / "r"), parts=True).collect()
    assert sorted(map(tuple, got)) == [(c, a, s.upper()) for c, a, s in sorted(chunks)]


def test_calls_as_text(spark, tmp_path):
    calls = spark.createDataFrame([("2", 5, 9, 0.9, "PASS"), ("10", 7, 9, 0.6, "LowQual"), ("1", 100, 150, 0.29, "LowQual")], "chrom string, start long, end long, quality double, filter_status string")
    line = t.call_lines(calls, 0.0).where("chrom = '1'").first().line
    assert line == "1\t100\t.\tN\t<DEL>\t28\tLowQual\tSVTYPE=DEL;END=150;SVLEN=-50\tGT\t0/1"
    t.write_calls(calls, str(tmp_path / "c"), "20240101", sample="NA1")
    rows = t.numbered_lines(spark, str(tmp_path / "c")).orderBy("k").collect()
    lines = [r.line for r in rows]
    assert [r.k for r in rows] == [*range(1, len(rows) + 1)]
    assert lines[0] == "##fileformat=VCFv4.3" and lines[1] == "##fileDate=20240101" and "##ALT=<ID=DEL,Description=\"Deletion\">" in lines and "##source=delspan" in lines
    assert lines[10].endswith("FORMAT\tNA1") and [x.split("\t")[0] for x in lines[11:]] == ["10", "2"]  # as text


def test_dataset_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, "1", 0, 50, "train"), ("s", 1, "1", 0, 50, "train"), ("s", 0, "1", 0, 50, "train"), ("s", 0, "12", 0, 50, "validation")], "sample string, label int, chrom string, start long, end long, split string")
    t.write_dataset(rows, str(tmp_path / "d"))
    assert t.read_dataset(spark, str(tmp_path / "d"), "train").count() == 2
    again = spark.createDataFrame([("s", 1, "1", 0, 50, "train"), ("s", 1, "2", 0, 50, "train"), (None, 1, "2", 0, 50, "train")], rows.schema)
    with pytest.raises(ValueError, match="scratch"):
        t.write_dataset(again, str(tmp_path / "d"))
    t.write_dataset(again, str(tmp_path / "d"), str(tmp_path / "s1"))
    t.write_dataset(again.limit(0), str(tmp_path / "d"), str(tmp_path / "s2"))
    t.write_dataset(again.where("sample is null"), str(tmp_path / "d"), str(tmp_path / "s3"))
    got = sorted((r["sample"] or "", r.label, str(r.chrom), r.split) for r in spark.read.parquet(str(tmp_path / "d")).collect())
    assert got == [("", 1, "2", "train"), ("s", 0, "1", "train"), ("s", 0, "12", "validation"), ("s", 1, "1", "train"), ("s", 1, "2", "train")]
    t.write_metrics(rows.limit(1), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 1
