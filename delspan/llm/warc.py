"""Operator 8: WARC archives of zstd frames with a dictionary: writing, and the reader.

An archive (``.warc.zst``) begins with a skippable frame that holds the compression dictionary; every record is a
frame of its own. :func:`write_archives` lets Spark's file writer put the frames into files, so that committing and
retrying tasks work on any file system; the separator it writes after each row is an empty skippable frame, which
readers of zstd pass over. A task closes an archive once it holds ``ARCHIVE_BYTES`` and begins another one with its own dictionary,
so a file is never larger than that and one record, however much a partition holds. :func:`read_archives` reads whole files with Spark's binary reader, loads the dictionary,
walks the frames, decodes one frame per record and validates version line, headers, lengths and digests.

Records with equal payloads of at least ``min_bytes`` bytes: that with the largest id is a response, the others are
revisits that refer to it. The groups are found on (id, digest, length) rows only; payloads are never gathered by digest,
so a page that makes up a third of all rows gathers nothing in one place.

Defined results: a null html is the empty payload; a null id is written as ``null``, read back as null, and always a
response that none refers to; repeated rows (equal id and payload) are written once each and have the same type; a null url
gets a name made of the id. An empty table gives no archive and an empty result. Other columns are not looked at.
A very long html is one record, in an archive that may be larger by it; Spark's values end at 2 GB. A record that is not valid raises an error, or is reported in ``error`` where ``strict`` is false.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, scratch_path

DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
#: An empty skippable frame: magic 0x184D2A50, length 0.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
#: The dictionary is trained on about so many records at most, of at most so many bytes each.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 32_768, 65_536
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"
OUT_BYTES, ARCHIVE_BYTES = 8 << 20, 64 << 20
READ_SCHEMA = "archive string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload string, error string"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One WARC record: a response, or a revisit if ``refers_to`` is given."""
    name = f"{ID}{'null' if page_id is None else page_id}"
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else name
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest32(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def frame_end(data: memoryview, at: int) -> int:
    """Where the zstd frame that begins at ``at`` ends, from its headers alone."""
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        head = int.from_bytes(data[at : at + 3], "little")
        if at + 3 > len(data):
            raise ValueError("a frame is cut off")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    at += 4 * checksum
    if at > len(data):
        raise ValueError("a frame is cut off")
    return at


def frames(data: bytes) -> Iterator[bytes]:
    """The decoded records of an archive."""
    view, at = memoryview(data), 0
    decoder = zstandard.ZstdDecompressor()
    while at < len(view):
        if at + 8 > len(view):
            raise ValueError("bytes after the last frame")
        magic, size = struct.unpack_from("<II", view, at)
        if magic == ZSTD_MAGIC:
            end = frame_end(view, at)
            yield decoder.decompress(bytes(view[at:end]))
            at = end
        elif magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + size > len(view):
                raise ValueError("a skippable frame is cut off")
            if magic == DICTIONARY_MAGIC:
                if at:
                    raise ValueError("a dictionary that doesn't lead the archive")
                stored = bytes(view[8 : 8 + size])
                if stored[:4] == struct.pack("<I", ZSTD_MAGIC):
                    stored = zstandard.ZstdDecompressor().decompress(stored)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stored))
            at += 8 + size
        else:
            raise ValueError(f"no frame at byte {at}")


def parse(data: bytes) -> dict:
    """The fields of one record, checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC record")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError(f"bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    if not re.fullmatch(r"\d+", fields["content-length"]):
        raise ValueError("bad content-length")
    n = int(fields["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("the block's length isn't its Content-Length")
    kind = fields["warc-type"]
    number = lambda x: None if (v := x.strip("<>").removeprefix(ID)) == "null" else int(v)
    out = {"page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": None, "payload": None}
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    if not gap or not http.startswith(b"HTTP/") or not length:
        raise ValueError("no HTTP response in the block")
    out["payload_bytes"] = int(length[1])
    out["payload_digest"] = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if len(payload) != out["payload_bytes"] or digest32(payload) != out["payload_digest"]:
            raise ValueError("the payload isn't what its length and digest say")
        out["payload"] = payload.decode("utf-8")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in fields or fields.get("warc-profile") != PROFILE:
            raise ValueError("bad revisit record")
        out["refers_to"] = number(fields["warc-refers-to"])
    else:
        raise ValueError(f"unexpected record type {kind}")
    return out


def train_dictionary(df: DataFrame, id_col: str, url_col: str, html_col: str) -> bytes:
    """A dictionary from a bounded sample of the records, picked by the html's hash; empty if there is too little to learn from."""
    every = max(1, df.count() // SAMPLE_RECORDS)
    cut = F.substring(F.col(html_col), 1, SAMPLE_BYTES // 4)  # of the sample only: a dictionary needs typical beginnings, not whole pages
    rows = df.where(F.col(html_col).isNotNull() & (F.pmod(F.xxhash64(html_col), F.lit(every)) == 0)).select(F.col(id_col), F.col(url_col), cut).limit(2 * SAMPLE_RECORDS).collect()
    samples = sorted(record(i, u, h.encode()) for i, u, h in rows)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write a record for each row into archives under ``path``; a record that reaches ``archive_bytes`` is the last of its archive."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    light = df.select(F.col(id_col).cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    light = light.where((F.col("n") >= min_bytes) & F.col("page_id").isNotNull())
    groups = light.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    revisits = light.join(groups, ["digest", "n"]).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"), F.sha1(payload).alias("digest"))
    rows = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    trained = train_dictionary(df, id_col, url_col, html_col)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = zstandard.ZstdCompressor(level=3, write_content_size=True, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        lead = b""
        if trained:
            stored = zstandard.ZstdCompressor(level=9).compress(trained)
            lead = struct.pack("<II", DICTIONARY_MAGIC, len(stored)) + stored
        out, held = [lead], len(lead)
        for batch in batches:
            for i, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append(encoder.compress(record(i, url, html.encode(), refers_to)))
                held += len(out[-1])
                if held >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["archive"])
                    out, held = [lead], len(lead)
        if len(out) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["archive"])

    archives = rows.mapInArrow(lean(write), "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 1).text(path)
    return path


def read_archives(spark: SparkSession, path: str, payloads: bool = True, strict: bool = True) -> DataFrame:
    """One row for each record of the archives under ``path``; without ``payloads`` the texts are checked but not returned."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload", "error"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

        def flush(archive: str, rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([archive] * len(rows), pa.string()), *(pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True))], ["archive", *names])

        for batch in batches:
            for archive, data in zip(batch.column(0), batch.column(1), strict=True):
                rows, held = [], 0
                try:
                    for raw in frames(data.as_py()):
                        try:
                            row = parse(raw)
                        except (ValueError, UnicodeDecodeError) as e:
                            if strict:
                                raise
                            row = {"error": str(e)}
                        held += len(raw)
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        if held >= OUT_BYTES:
                            yield flush(archive.as_py(), rows)
                            rows, held = [], 0
                except (ValueError, zstandard.ZstdError) as e:
                    if strict:
                        raise ValueError(f"{archive.as_py()}: {e}") from e
                    rows.append({"error": str(e)})
                if rows:
                    yield flush(archive.as_py(), rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(lean(read), READ_SCHEMA)


def round_trip(df: DataFrame) -> DataFrame:
    """What reading gives for each page after writing all of ``df``."""
    spark = df.sparkSession
    path = write_archives(df, scratch_path(spark, "warc"))
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST((15 - 5 * (i % 4)) AS BIGINT)) & 31 AS BIGINT), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = last OR page_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM q
"""
