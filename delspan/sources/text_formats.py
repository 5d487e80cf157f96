"""Variant, alignment and reference text formats as DataFrames, and calls as variant text.

Plain or gzipped text is read by Spark's text reader; binary containers are not decoded (see the README). A gzipped file is
one partition, so callers repartition after reading.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Header lines of call files, after the two with the format and the date.
HEADER = (
    "##source=delspan", '##ALT=<ID=DEL,Description="Deletion">', '##FILTER=<ID=PASS,Description="All filters passed">', '##FILTER=<ID=LowQual,Description="Low quality">',
    '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="Type of structural variant">', '##INFO=<ID=END,Number=1,Type=Integer,Description="End position">', '##INFO=<ID=SVLEN,Number=1,Type=Integer,Description="Length">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
)
COLUMNS = ("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")


def _fields() -> Callable[[int], Column]:
    """The tab-separated fields of a line; null where there are fewer. Spark may look at a line's fields before it drops the line as a header."""
    fields = F.split("value", "\t")
    return lambda k: F.get(fields, F.lit(k))


def genotype(text: Column) -> Column:
    """Alleles of ``0|1:...`` as ``array<int>``; a missing allele is null."""
    return F.transform(F.split(F.split(text, ":")[0], r"[/|]"), lambda a: a.try_cast("int"))


def read_variants(spark: SparkSession, path: str, sample: str | None = None) -> DataFrame:
    """Records of a variant text file: ``chrom, pos, id, ref, alts, qual, filter, svtype, info_end, gt``.

    ``gt`` holds the genotypes to look at: the sample's only, if one is named, else all samples' joined. A sample that the
    header doesn't have is an error.
    """
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("##")))
    header = lines.where(F.startswith("value", F.lit("#CHROM"))).first()
    if header is None:
        raise ValueError(f"{path} has no #CHROM line")
    samples = header.value.split("\t")[9:]
    if sample is not None and sample not in samples:
        raise ValueError(f"sample {sample} is not among {len(samples)} samples")
    f = _fields()
    info = F.str_to_map(f(7), F.lit(";"), F.lit("="))
    wanted = [samples.index(sample)] if sample is not None else range(len(samples))
    gt = F.flatten(F.array(*(genotype(f(9 + k)) for k in wanted))) if samples else F.lit(None).cast("array<int>")
    end = F.split(F.try_element_at(info, F.lit("END")), ",")[0].try_cast("bigint")
    return lines.where(~F.startswith("value", F.lit("#"))).select(
        f(0).alias("chrom"), f(1).try_cast("bigint").alias("pos"), f(2).alias("id"), f(3).alias("ref"), F.split(f(4), ",").alias("alts"), f(5).try_cast("double").alias("qual"), f(6).alias("filter"),
        F.split(F.try_element_at(info, F.lit("SVTYPE")), ",")[0].alias("svtype"), end.alias("info_end"), gt.alias("gt"),
    )


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Reads with a CIGAR from alignment text: ``qname, flag, chrom, ref_start`` (0-based) ``, mapq, cigar, tlen, seq, qual``."""
    f = _fields()
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("@")))
    return rows.where(f(5) != "*").select(
        f(0).alias("qname"), f(1).try_cast("int").alias("flag"), f(2).alias("chrom"), (f(3).try_cast("bigint") - 1).alias("ref_start"), f(4).try_cast("bigint").alias("mapq"), f(5).alias("cigar"), f(8).try_cast("bigint").alias("tlen"), f(9).alias("seq"), f(10).alias("qual"),
    )


def sample_alignments(spark: SparkSession, folder: str, sample: str) -> DataFrame:
    """The alignments of a sample's only file in ``folder``; no file, or more than one, is an error."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", f"*{sample}*").load(folder).select("path").limit(2).collect()
    if len(names) != 1:
        raise ValueError(f"{'no file' if not names else 'more than one file'} of sample {sample} in {folder}")
    return read_alignments(spark, names[0].path)


def alignment_contigs(spark: SparkSession, path: str, first: int = 25) -> tuple[DataFrame, int]:
    """The first contigs of an alignment header with their lengths (``idx, contig, length``), and how many more there are."""
    lines = spark.read.text(path).where(F.startswith("value", F.lit("@SQ"))).withColumn("idx", F.monotonically_increasing_id())
    found = lines.select("idx", F.regexp_extract("value", r"SN:([^\t]+)", 1).alias("contig"), F.regexp_extract("value", r"LN:(\d+)", 1).try_cast("bigint").alias("length"))
    return found.orderBy("idx").limit(first), max(0, found.count() - first)


def read_reference(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """``chrom, chunk_start, seq`` (upper case): one row for each line of FASTA text, however long its lines are.

    ``parts``: the files are parts of one text in the order of their names, so a contig may go on in the next file.

    Lines are numbered within the splits that Spark reads; of each split only its length and its last record's name and start go on to later
    splits of the file, so a chromosome is never one value and a file is read by many tasks.
    """
    lines = spark.read.text(path).select(F.rtrim("value").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    head = F.startswith("value", F.lit(">"))
    lines = lines.where(F.length("value") > 0).withColumn("name", F.when(head, F.regexp_extract("value", r"^>(\S*)", 1))).withColumn("n", F.when(head, 0).otherwise(F.length("value")).cast("bigint"))
    order = Window.partitionBy("file", "split").orderBy("id")
    lines = lines.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    record = F.last(F.when(F.col("name").isNotNull(), F.struct("name", F.col("upto").alias("at"))), ignorenulls=True)
    lines = lines.withColumn("record", record.over(order.rowsBetween(Window.unboundedPreceding, 0)))
    splits = lines.groupBy("file", "split").agg(F.sum("n").alias("n"), F.max_by("record", "id").alias("last"))
    order = Window.orderBy("file", "split") if parts else Window.partitionBy("file").orderBy("split")  # a row for each split
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    last = F.when(F.col("last").isNotNull(), F.struct(F.col("last.name").alias("name"), (F.col("before") + F.col("last.at")).alias("at")))
    splits = splits.select("file", "split", "before", F.last(last, ignorenulls=True).over(earlier).alias("open"))
    rows = lines.where("name is null").join(splits, ["file", "split"])
    start = F.col("before") + F.col("upto") - F.coalesce(F.col("before") + F.col("record.at"), F.col("open.at"))
    return rows.select(F.coalesce("record.name", "open.name").alias("chrom"), start.alias("chunk_start"), F.upper("value").alias("seq"))


def call_lines(calls: DataFrame, min_quality: float = 0.5) -> DataFrame:
    """``chrom, start, line``: a record line for each call (chrom, start, end, quality, filter_status) of that quality or more."""
    info = F.concat(F.lit("SVTYPE=DEL;END="), F.col("end"), F.lit(";SVLEN=-"), F.abs(F.col("end") - F.col("start")))
    line = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.lit("."), F.lit("N"), F.lit("<DEL>"), (F.col("quality") * 100).cast("int").cast("string"), "filter_status", info, F.lit("GT"), F.lit("0/1"))
    return calls.where(F.col("quality") >= min_quality).select("chrom", "start", line.alias("line"))


def write_calls(calls: DataFrame, path: str, date: str, min_quality: float = 0.5, sample: str = "SAMPLE") -> None:
    """Write calls as variant text, sorted by chromosome name and start. ``date`` and ``sample``: for the header.

    The rows are range-partitioned, so the text is as many part files as there are ranges, in the order of their names; the header begins the first.
    """
    spark = calls.sparkSession
    head = ["##fileformat=VCFv4.3", f"##fileDate={date}", *HEADER, "\t".join([*COLUMNS, sample])]
    header = spark.createDataFrame([(0, k, "", 0, x) for k, x in enumerate(head)], "part int, k int, chrom string, start long, line string")
    body = call_lines(calls, min_quality).select(F.lit(1).alias("part"), F.lit(0).alias("k"), "chrom", "start", "line")
    header.unionByName(body).orderBy("part", "chrom", "start", "k").select("line").write.text(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``k, line``: the lines of a text's part files in the order of their names, from 1; numbered within splits and by running totals over splits."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    before = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    counts = lines.groupBy("file", "split").agg(F.count("*").alias("n")).select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("file", "split").orderBy("id"))
    return lines.withColumn("own", own).join(counts, ["file", "split"]).select((F.col("before") + F.col("own")).alias("k"), "line")


def write_reference(chunks: DataFrame, path: str) -> None:
    """Chunks (chrom, chunk_start, seq) as FASTA text, a line for each chunk after its contig's name; part files in order, whatever a contig's length."""
    heads = chunks.select("chrom").distinct().select("chrom", F.lit(-1).cast("bigint").alias("chunk_start"), F.concat(F.lit(">"), "chrom").alias("line"))
    lines = heads.unionByName(chunks.select("chrom", F.col("chunk_start").cast("bigint"), F.col("seq").alias("line")))
    lines.orderBy("chrom", "chunk_start").select("line").write.text(path)


KEY = ("sample", "label", "chrom", "start", "end")


def write_dataset(samples: DataFrame, path: str, scratch: str | None = None) -> None:
    """Samples as Parquet by split and label; rows of equal key (``KEY``) are one sample, and samples that are there already are replaced.

    What the touched partitions keep of earlier writes is written beside the new rows to ``scratch`` first (needed if ``path`` has a dataset), then
    those partitions are exchanged as a whole when the write commits; others are left alone.
    """
    spark = samples.sparkSession
    new = samples.dropDuplicates([*KEY])
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        if scratch is None:
            raise ValueError(f"{path} has a dataset; a scratch folder is needed to add to it")
        new.write.parquet(f"{scratch}/new")
        new = spark.read.parquet(f"{scratch}/new")
        old = spark.read.schema(samples.schema).parquet(path).join(new.select("split", "label").distinct(), ["split", "label"], "left_semi")
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in KEY]
        kept = old.alias("o").join(new.select(*KEY).alias("n"), same, "left_anti")
        kept.unionByName(new).write.parquet(f"{scratch}/merged")
        new = spark.read.schema(samples.schema).parquet(f"{scratch}/merged")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split", "label").parquet(path)


def read_dataset(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.json(path)
