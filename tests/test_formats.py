import gzip
import random

import pytest
from pyspark.sql import functions as F

from delspan.sources import formats as f
from delspan.sources import text_formats as t

HEAD = "##fileformat=VCFv4.3\n##note\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n"


def variant_lines(n, seed=5):
    rng = random.Random(seed)
    gt = lambda: rng.choice(["0|1", "1/1:9", ".|1", "0|0", "./.:3"])
    end = lambda k: rng.choice([f"SVTYPE=DEL;END={k + 9}", "SVTYPE=DUP;X", "END=7,8;SVTYPE=DEL,INS", "."])
    return [f"{rng.choice('12X')}\t{k}\tid{k}\t{'N' * rng.randrange(1, 90)}\t{rng.choice(['<DEL>', 'A,<DEL>'])}\t{rng.choice(['.', '30', '1.5e2'])}\tPASS\t{end(k)}\tGT\t{gt()}\t{gt()}" for k in range(n)]


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    f.register(spark)
    d = tmp_path_factory.mktemp("formats")
    text = (HEAD + "\n".join(variant_lines(4_000)) + "\n").encode()
    (d / "plain.vcf").write_bytes(text)
    (d / "crlf.vcf").write_bytes(text.replace(b"\n", b"\r\n").rstrip())
    (d / "stream.vcf.gz").write_bytes(gzip.compress(text[:50_000]) + gzip.compress(text[50_000:]))
    (d / "blocks.vcf.gz").write_bytes(b"".join(f.block(text[k : k + 3_001]) for k in range(0, len(text), 3_001)) + f.BLOCK_END)
    return d


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", ["plain.vcf", "crlf.vcf", "stream.vcf.gz", "blocks.vcf.gz"])
@pytest.mark.parametrize("sample", [None, "S2"])
def test_every_container_equals_the_text_reader(spark, sources, name, sample):
    want = rows(t.read_variants(spark, f"{sources}/plain.vcf", sample))
    for split in (6_000, 1 << 26):
        options = {"splitBytes": split} | ({"sample": sample} if sample else {})
        got = spark.read.format("variant_text").options(**options).load(f"{sources}/{name}")
        assert got.where("malformed is not null").count() == 0
        assert rows(got.drop("malformed", "line")) == want
        assert (got.rdd.getNumPartitions() > 1) == (split < 1 << 26 and "stream" not in name)


@pytest.mark.parametrize("at", [1, 2, 3, 5, 8, 13])
def test_lines_of_ranges_are_the_lines_of_the_file(tmp_path, at):
    from pyarrow import fs

    rng = random.Random(at)
    text = b"".join(bytes(rng.choice(b"ab\n\n") for _ in range(rng.randrange(9))) for _ in range(60))
    kept = [x for x in text.split(b"\n") if x]
    (tmp_path / "p").write_bytes(text)
    (tmp_path / "b").write_bytes(b"".join(f.block(text[k : k + 7]) for k in range(0, len(text), 7)) + f.BLOCK_END)
    for name in "pb":
        with fs.LocalFileSystem().open_input_file(f"{tmp_path}/{name}") as file:
            size = file.size()
            step = at if name == "p" else 11 * at
            got = [x for s in range(0, size, step) for part in f.lines(file, s, min(size, s + step)) for x in part.split(b"\n") if x]
        assert got == kept


def test_filters_are_pushed(spark, sources):
    read = spark.read.format("variant_text").option("splitBytes", 30_000).load(f"{sources}/blocks.vcf.gz")
    kept = read.where("chrom in ('1', 'X') and pos >= 100 and pos < 900 and id <> 'id200'")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "chrom" not in plan.split("Filter")[1].split("\n")[0].replace("isnotnull(chrom", "") if "Filter" in plan else True
    want = t.read_variants(spark, f"{sources}/plain.vcf").where("chrom in ('1', 'X') and pos >= 100 and pos < 900 and id <> 'id200'")
    assert rows(kept.drop("malformed", "line")) == rows(want)


def test_writer_commits_and_readers_leave_out_files(spark, sources, tmp_path):
    path = str(tmp_path / "w")
    found = t.read_variants(spark, f"{sources}/plain.vcf", "S1").repartitionByRange(6, "chrom", "pos")
    found.write.format("variant_text").option("sample", "S1").mode("append").save(path)
    read = spark.read.format("variant_text").option("sample", "S1").load(path)
    same = lambda df: rows(df.select("chrom", "pos", "id", "ref", "alts", "qual", "svtype", "info_end", "gt"))
    assert same(read) == same(found)
    parts = read.rdd.getNumPartitions()
    assert read.where("chrom = 'X'").rdd.getNumPartitions() < parts
    assert read.where("chrom = '1' and pos > 3900").rdd.getNumPartitions() == 1
    assert same(read.where("chrom = '1' and pos > 3900")) == same(found.where("chrom = '1' and pos > 3900"))
    assert read.where("chrom = 'none'").count() == 0
    found.limit(3).write.format("variant_text").option("sample", "S1").mode("append").save(path)
    assert spark.read.format("variant_text").load(path).count() == 4_003
    found.where("pos = 5").write.format("variant_text").option("sample", "S1").mode("overwrite").save(path)
    assert spark.read.format("variant_text").load(path).count() == 1
    assert not [x for x in (tmp_path / "w").iterdir() if x.name.startswith("_staged")]
    failing = found.withColumn("pos", F.when(F.col("pos") == 77, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("pos")))
    with pytest.raises(Exception):  # noqa: B017
        failing.write.format("variant_text").mode("overwrite").save(path)
    assert spark.read.format("variant_text").load(path).count() == 1


def test_malformed_lines_and_alignments(spark, tmp_path):
    f.register(spark)
    (tmp_path / "bad.vcf").write_text(HEAD + "1\t5\ta\tN\t<DEL>\t.\tPASS\t.\tGT\t0|1\t1\n1\tx\tb\tN\tA\t.\t.\t.\tGT\t0\t0\n\nshort\t1\n")
    got = spark.read.format("variant_text").load(str(tmp_path / "bad.vcf")).orderBy(F.col("malformed").asc_nulls_first()).collect()
    assert [(r.chrom, r.pos, r.malformed, r.line) for r in got] == [("1", 5, None, None), (None, None, "fields", "short\t1"), (None, None, "position", "1\tx\tb\tN\tA\t.\t.\t.")]
    assert got[0].gt == [0, 1, 1]
    (tmp_path / "empty.sam").write_text("")
    assert spark.read.format("alignment_text").load(str(tmp_path / "empty.sam")).count() == 0
    (tmp_path / "a.sam").write_text("@HD\tVN:1\nr1\t99\t1\t11\t60\t5S10M\t=\t111\t120\tACGT\tIIII\tNM:i:1\tX:Z:a\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    got = spark.read.format("alignment_text").load(str(tmp_path / "a.sam")).orderBy("qname").collect()
    assert [tuple(r)[:9] for r in got] == [("r1", 99, "1", 11, 60, "5S10M", 120, "ACGT", "IIII"), ("r2", 4, "*", 0, 0, "*", 0, "AC", "II")]
    with pytest.raises(Exception, match="S9"):
        spark.read.format("variant_text").option("sample", "S9").load(str(tmp_path / "bad.vcf")).count()
    (tmp_path / "cut.vcf.gz").write_bytes(f.block(HEAD.encode())[:-3])
    with pytest.raises(Exception, match="block"):
        spark.read.format("variant_text").load(str(tmp_path / "cut.vcf.gz")).count()
