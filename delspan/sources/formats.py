"""Variant and alignment text as data sources: ``spark.read.format("variant_text" | "alignment_text")`` and ``df.write.format("variant_text")``.

Files are cut into byte ranges: plain text anywhere, block-gzipped text where a block begins, so a large ``.vcf.gz`` is many tasks. Text that
was gzipped as one stream can't be cut and is one task a file. A line belongs to the range that holds the end of the line before it.
Filters on ``chrom`` and ``pos`` are pushed into the source, which drops rows before it looks at their other fields. The writer
makes one block-gzipped file a task in a staging folder; committing moves them into place and notes each file's chromosomes
and positions in ``_ranges.json``, by which later readers leave out whole files.

Files are opened through ``pyarrow.fs``, which must know the path's file system (local, HDFS, S3, GCS). :func:`register` makes the formats known to a session.

Defined results: empty lines are passed over; an empty file or folder gives no row, but a variant source needs a ``#CHROM`` line somewhere. A line with too few fields, or
whose position isn't a whole number, is a row that only has ``malformed`` (``fields`` or ``position``) and ``line``; for other rows these two are null.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .text_formats import COLUMNS

VARIANTS = "chrom string, pos long, id string, ref string, alts array<string>, qual double, filter string, svtype string, info_end long, gt array<int>, malformed string, line string"
ALIGNMENTS = "qname string, flag int, chrom string, pos long, mapq long, cigar string, tlen long, seq string, qual string, malformed string, line string"
SPLIT_BYTES, PARSE_BYTES, READ_BYTES = 64 << 20, 4 << 20, 1 << 20
RANGES = "_ranges.json"
#: A block's header as block-gzip writers give it (its size follows), and the empty block that ends a file: fixed values of the format.
BLOCK_HEAD = bytes.fromhex("1f8b08040000000000ff060042430200")
BLOCK_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK_TEXT = 65_280


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


def block(text: bytes) -> bytes:
    """One block of at most ``BLOCK_TEXT`` bytes of text."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(text) + deflate.flush()
    return BLOCK_HEAD + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(text), len(text))


def block_size(head: bytes, at: int = 0) -> int:
    """The size of the block whose header is at ``at``; 0 if there is none."""
    if head[at : at + 4] != BLOCK_HEAD[:4] or len(head) < at + 12:
        return 0
    extra = head[at + 12 : at + 12 + struct.unpack_from("<H", head, at + 10)[0]]
    while len(extra) >= 6:
        n = struct.unpack_from("<H", extra, 2)[0]
        if extra[:2] == b"BC" and n == 2:
            return struct.unpack_from("<H", extra, 4)[0] + 1
        extra = extra[4 + n :]
    return 0


def kind_of(file: pa.NativeFile) -> str:
    head = file.read_at(64, 0)
    return "blocks" if block_size(head) else "gzip" if head[:2] == b"\x1f\x8b" else "plain"


def first_block(file: pa.NativeFile, start: int) -> int:
    """Where the first block at or after ``start`` begins: its header must lead to another one, or to the end of the file."""
    size = file.size()
    near = file.read_at(1 << 18, start)
    at = near.find(BLOCK_HEAD[:4])
    while at >= 0:
        n = block_size(near, at)
        if n and (start + at + n == size or block_size(file.read_at(64, start + at + n))):
            return start + at
        at = near.find(BLOCK_HEAD[:4], at + 1)
    return size


def pieces(file: pa.NativeFile, kind: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place in the file, text) from ``start`` on, as far as the caller asks; no piece of plain text crosses ``end``."""
    size = file.size()
    if kind == "gzip":
        inflate, at = zlib.decompressobj(31), 0
        while at < size:
            data, place = file.read_at(READ_BYTES, at), at
            at += len(data)
            while data:
                yield place, inflate.decompress(data, READ_BYTES)
                data = inflate.unconsumed_tail
                if inflate.eof:  # files may be gzipped in several parts
                    data, inflate = inflate.unused_data, zlib.decompressobj(31)
        if inflate.flush() or not inflate.eof and size and inflate.unconsumed_tail:
            raise ValueError("a gzipped file is cut off")
    elif kind == "plain":
        at = start
        while at < size:
            data = file.read_at(min(READ_BYTES, end - at) if at < end else 1 << 16, at)
            yield at, data
            at += len(data)
    else:
        at = first_block(file, start) if start else 0
        while at < size:
            held, place = file.read_at(READ_BYTES, at), 0
            while (n := block_size(held, place)) and place + n <= len(held):
                head = 12 + struct.unpack_from("<H", held, place + 10)[0]
                text = zlib.decompress(held[place + head : place + n - 8], -15)
                if struct.unpack_from("<II", held, place + n - 8) != (zlib.crc32(text), len(text)):
                    raise ValueError(f"the block at byte {at + place} isn't what its checksum says")
                yield at + place, text
                place += n
            if not place:
                raise ValueError(f"no whole block at byte {at}")
            at += place


def lines(file: pa.NativeFile, start: int, end: int) -> Iterator[bytes]:
    """The whole lines of a byte range, about ``PARSE_BYTES`` at a time."""
    held: list[bytes] = []
    n, skip = 0, start > 0
    for place, text in pieces(file, kind_of(file), start, end):
        if place >= end:  # only the rest of the last line
            if skip:
                return
            stop = text.find(b"\n")
            held.append(text if stop < 0 else text[:stop])
            if stop >= 0:
                break
            continue
        if skip:
            at = text.find(b"\n")
            if at < 0:
                continue
            text, skip = text[at + 1 :], False
        held.append(text)
        n += len(text)
        if n >= PARSE_BYTES:
            whole, newline, rest = b"".join(held).rpartition(b"\n")
            if newline:
                yield whole
            held, n = [rest], len(rest)
    if any(held):
        yield b"".join(held)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class Fields:
    """Tab-separated fields of many lines at once."""

    def __init__(self, text: bytes, comment: bytes, need: int, most: int) -> None:
        found = pc.split_pattern(pa.array([text], pa.binary()), b"\n").flatten().cast(pa.string())
        found = pc.utf8_rtrim(found, "\r")
        found = found.filter(pc.and_(pc.greater(pc.binary_length(found), 0), pc.invert(pc.starts_with(found, comment.decode()))))
        split = pc.split_pattern(found, "\t", max_splits=most)
        enough = pc.greater_equal(pc.list_value_length(split), need)
        self.short = found.filter(pc.invert(enough))
        self.split = split.filter(enough)

    def __len__(self) -> int:
        return len(self.split)

    def __getitem__(self, k: int) -> pa.Array:
        return self.split.values.take(pc.add(self.split.offsets[:-1], k))

    def where(self, mask: pa.Array) -> None:
        self.split = self.split.filter(mask)

    def head(self, k: int) -> pa.Array:
        return pc.binary_join_element_wise(*(self[i] for i in range(k)), "\t")


def whole_numbers(text: pa.Array, kind: pa.DataType) -> pa.Array:
    """Null where the text is no number that fits."""
    digits = 18 if kind == pa.int64() else 9
    return pc.if_else(pc.match_substring_regex(text, rf"^[+-]?[0-9]{{1,{digits}}}$"), text, None).cast(pa.string()).cast(kind)


def decimals(text: pa.Array) -> pa.Array:
    return pc.if_else(pc.match_substring_regex(text, r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text, None).cast(pa.string()).cast(pa.float64())


def info_value(info: pa.Array, key: str) -> pa.Array:
    found = pc.struct_field(pc.extract_regex(info, rf"(?:^|;){key}=(?P<value>[^;,]*)"), "value")
    return pc.if_else(pc.is_null(found), None, found).cast(pa.string())


def alleles(text: pa.Array) -> pa.Array:
    split = pc.split_pattern_regex(text, "[/|]")
    return pa.ListArray.from_arrays(split.offsets, whole_numbers(split.values, pa.int32()))


TESTS = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


class TextReader(DataSourceReader):
    """Byte ranges of the files of a path. Subclasses parse lines."""

    comment, fields, chrom, position = b"#", 0, 0, 1
    columns: tuple[tuple[str, pa.DataType], ...] = ()

    def __init__(self, options: dict) -> None:
        if "path" not in options:
            raise ValueError("a path is needed")
        self.path = options["path"]
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.chroms: set[str] | None = None
        self.tests: list[tuple[type, int]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("chrom",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.chroms = wanted if self.chroms is None else self.chroms & wanted
            elif type(f) in TESTS and f.attribute == ("pos",):
                self.tests.append((type(f), f.value))
            else:
                yield f

    def files(self) -> list[fs.FileInfo]:
        system, path = open_folder(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path))
        return sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)

    def may_hold(self, ranges: dict[str, list[int]]) -> bool:
        """Whether a file with these least and greatest positions by chromosome may have rows that the pushed filters want."""
        wanted = [r for c, r in ranges.items() if self.chroms is None or c in self.chroms]
        open_above = lambda r: all(not (t in (LessThan, LessThanOrEqual, EqualTo)) or (r[0] < v or r[0] == v and t is not LessThan) for t, v in self.tests)
        open_below = lambda r: all(not (t in (GreaterThan, GreaterThanOrEqual, EqualTo)) or (r[1] > v or r[1] == v and t is not GreaterThan) for t, v in self.tests)
        return any(open_above(r) and open_below(r) for r in wanted)

    def partitions(self) -> list[Range]:
        system, path = open_folder(self.path)
        noted: dict[str, dict] = {}
        if (self.chroms is not None or self.tests) and system.get_file_info(f"{path}/{RANGES}").type == fs.FileType.File:
            with system.open_input_stream(f"{path}/{RANGES}") as file:
                noted = json.loads(file.read())
        out = []
        for info in self.files():
            note = noted.get(info.base_name)
            if note and note["size"] == info.size and not self.may_hold(note["ranges"]):
                continue
            with system.open_input_file(info.path) as file:
                step = info.size if kind_of(file) == "gzip" else self.split_bytes
            out += [Range(info.path, at, min(at + step, info.size)) for at in range(0, info.size, max(1, step))]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there was no file to read
            return
        system, _ = open_folder(self.path)
        with system.open_input_file(partition.path) as file:
            for text in lines(file, partition.start, partition.end):
                found = Fields(text, self.comment, *self.widths())
                unread = len(found.short), found.short
                pos = whole_numbers(found[self.position], pa.int64())
                placeless = found.head(self.fields).filter(pc.is_null(pos))
                wanted = pc.is_valid(pos)
                if self.chroms is not None:
                    wanted = pc.and_(wanted, pc.is_in(found[self.chrom], pa.array(sorted(c for c in self.chroms if c is not None), pa.string())))
                for test, value in self.tests:
                    wanted = pc.and_(wanted, pc.fill_null(TESTS[test](pos, value), False))
                found.where(wanted)
                yield self.batch(self.parsed(found, pos.filter(wanted)), len(found))
                if self.chroms is None and not self.tests:
                    for reason, bad in (("fields", unread[1]), ("position", placeless)):
                        if len(bad):
                            yield self.batch([None] * len(self.columns), len(bad), pa.array([reason] * len(bad)), bad)

    def batch(self, columns: list, n: int, malformed: pa.Array | None = None, line: pa.Array | None = None) -> pa.RecordBatch:
        types = [*(t for _, t in self.columns), pa.string(), pa.string()]
        arrays = [pa.nulls(n, t) if c is None else c.cast(t) for c, t in zip([*columns, malformed, line], types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, [*(c for c, _ in self.columns), "malformed", "line"])

    def widths(self) -> tuple[int, int]:
        return self.fields, self.fields

    def parsed(self, f: Fields, pos: pa.Array) -> list[pa.Array]:
        raise NotImplementedError


class VariantReader(TextReader):
    fields = 8
    columns = (
        ("chrom", pa.string()), ("pos", pa.int64()), ("id", pa.string()), ("ref", pa.string()), ("alts", pa.list_(pa.string())), ("qual", pa.float64()), ("filter", pa.string()), ("svtype", pa.string()),
        ("info_end", pa.int64()), ("gt", pa.list_(pa.int32())),
    )

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        system, _ = open_folder(self.path)
        names: list[str] | None = None
        for info in self.files():
            with system.open_input_file(info.path) as file:
                names = self.samples_of(file)
            if names is not None:
                break
        if names is None:
            raise ValueError(f"{self.path} has no #CHROM line")
        sample = options.get("sample")
        if sample is not None and sample not in names:
            raise ValueError(f"sample {sample} is not among {len(names)} samples")
        self.wanted = [names.index(sample)] if sample is not None else [*range(len(names))]

    def samples_of(self, file: pa.NativeFile) -> list[str] | None:
        """The samples of a file's header, of which no more is read than there is."""
        held = b""
        for _, text in pieces(file, kind_of(file), 0, file.size()):
            held += text
            *whole, held = held.split(b"\n")
            for line in whole:
                if line.startswith(b"#CHROM"):
                    return line.decode().rstrip("\r").split("\t")[9:]
                if line and not line.startswith(b"##"):
                    return None
        return held.decode().rstrip("\r").split("\t")[9:] if held.startswith(b"#CHROM") else None

    def widths(self) -> tuple[int, int]:
        need = 10 + max(self.wanted) if self.wanted else 8
        return need, need

    def parsed(self, f: Fields, pos: pa.Array) -> list[pa.Array]:
        info = f[7]
        gt = None
        if self.wanted:
            each = [pc.struct_field(pc.extract_regex(f[9 + k], "^(?P<gt>[^:]*)"), "gt") for k in self.wanted]
            gt = alleles(pc.binary_join_element_wise(*each, "|"))
        return [f[0], pos, f[2], f[3], pc.split_pattern(f[4], ","), decimals(f[5]), f[6], info_value(info, "SVTYPE"), whole_numbers(info_value(info, "END"), pa.int64()), gt]


class AlignmentReader(TextReader):
    comment, fields, chrom, position = b"@", 11, 2, 3
    columns = (
        ("qname", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("pos", pa.int64()), ("mapq", pa.int64()), ("cigar", pa.string()), ("tlen", pa.int64()), ("seq", pa.string()), ("qual", pa.string()),
    )

    def parsed(self, f: Fields, pos: pa.Array) -> list[pa.Array]:
        return [f[0], whole_numbers(f[1], pa.int32()), f[2], pos, whole_numbers(f[4], pa.int64()), f[5], whole_numbers(f[8], pa.int64()), f[9], f[10]]


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    ranges: dict[str, list[int]]


def record_lines(batch: pa.RecordBatch) -> pa.Array:
    """Lines of variants with the columns of ``VARIANTS``; what is missing or null is a dot."""
    names = batch.schema.names
    get = lambda c, t: batch.column(names.index(c)).cast(t) if c in names else pa.nulls(len(batch), t)
    text = lambda c: get(c, pa.string())

    def joined(lists: pa.Array, between: str) -> pa.Array:
        values = pc.fill_null(lists.values.cast(pa.string()), ".")
        return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, values), between)

    alts, gt = get("alts", pa.list_(pa.string())), get("gt", pa.list_(pa.int32()))
    pairs = [pc.fill_null(pc.binary_join_element_wise(f"{key}=", text(c), ""), "") for key, c in (("SVTYPE", "svtype"), ("END", "info_end"))]
    info = pc.utf8_trim(pc.binary_join_element_wise(*pairs, ";"), ";")
    columns = [text("chrom"), text("pos"), text("id"), text("ref"), joined(alts, ","), text("qual"), text("filter"), info, pa.array(["GT"] * len(batch), pa.string()), joined(gt, "|")]
    dotted = [pc.if_else(pc.equal(pc.fill_null(c, ""), ""), ".", c) for c in columns]
    return pc.binary_join_element_wise(*dotted, "\t")


class VariantWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.sample, self.overwrite = options["path"], options.get("sample", "SAMPLE"), overwrite
        self.stage = f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = open_folder(self.path)
        system.create_dir(f"{path}/{self.stage}", recursive=True)
        name = f"part-{uuid.uuid4().hex}.vcf.gz"  # an attempt's own: what a lost executor leaves behind is never moved into place
        ranges: dict[str, list[int]] = {}
        size, held = 0, ("##fileformat=VCFv4.3\n" + "\t".join([*COLUMNS, self.sample]) + "\n").encode()
        with system.open_output_stream(f"{path}/{self.stage}/{name}", compression=None) as out:
            for batch in iterator:
                if not len(batch):
                    continue
                held += "\n".join(record_lines(batch).to_pylist()).encode() + b"\n"
                for at in range(0, len(held) - BLOCK_TEXT, BLOCK_TEXT):
                    out.write(block(held[at : at + BLOCK_TEXT]))
                held = held[(len(held) - 1) // BLOCK_TEXT * BLOCK_TEXT :]
                places = pa.table({"chrom": batch.column("chrom").cast(pa.string()), "pos": batch.column("pos").cast(pa.int64())}).group_by("chrom").aggregate([("pos", "min"), ("pos", "max")])
                for r in places.to_pylist():
                    if r["chrom"] is not None and r["pos_min"] is not None:
                        low, high = ranges.get(r["chrom"], (r["pos_min"], r["pos_max"]))
                        ranges[r["chrom"]] = [min(low, r["pos_min"]), max(high, r["pos_max"])]
            out.write(block(held) + BLOCK_END)
            size = out.tell()
        return Written(name, size, ranges)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = open_folder(self.path)
        system.create_dir(path, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File]
        notes = {}
        if self.overwrite:
            for f in old:
                system.delete_file(f)
        elif f"{path}/{RANGES}" in old:
            with system.open_input_stream(f"{path}/{RANGES}") as file:
                notes = json.loads(file.read())
        for m in filter(None, messages):
            system.move(f"{path}/{self.stage}/{m.name}", f"{path}/{m.name}")
            notes[m.name] = {"size": m.size, "ranges": m.ranges}
        with system.open_output_stream(f"{path}/{RANGES}") as out:
            out.write(json.dumps(notes).encode())
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, path = open_folder(self.path)
        if system.get_file_info(f"{path}/{self.stage}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.stage}")


class VariantText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "variant_text"

    def schema(self) -> str:
        return VARIANTS

    def reader(self, schema) -> VariantReader:
        return VariantReader(self.options)

    def writer(self, schema, overwrite: bool) -> VariantWriter:
        return VariantWriter(self.options, overwrite)


class AlignmentText(DataSource):
    """``pos`` is the 1-based position of the line; every line that isn't a header is a row, with or without a CIGAR."""

    @classmethod
    def name(cls) -> str:
        return "alignment_text"

    def schema(self) -> str:
        return ALIGNMENTS

    def reader(self, schema) -> AlignmentReader:
        return AlignmentReader(self.options)


def register(spark: SparkSession) -> None:
    """Make both formats known to the session, and let filters be pushed into them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VariantText)
    spark.dataSource.register(AlignmentText)
