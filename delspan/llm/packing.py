"""Operator 13: packing documents into sequences by best-two-fit.

A document is its token ids and an end id. Only documents longer than a sequence are cut, into pieces as long as a sequence; the first
piece is what remains. Pieces are packed by best-two-fit: a sequence is filled greedily, the longest piece that fits
each time; then its shortest piece is replaced by two unpacked ones if they fill the gap that it leaves more tightly.

Lengths are whole numbers up to ``CAPACITY``, so the packing is worked out from how many pieces there are of each length
(at most ``CAPACITY`` rows, however many documents): as long as no length runs out, the next sequence has the lengths of the one before,
so a pattern is found once and used as often as its lengths last. Each pattern exhausts a length, so there are about ``CAPACITY`` times
its logarithm of them at most. Pieces learn their place by their number among the pieces of their length, which is counted within
buckets of bounded size and running totals over buckets: no length, however common, is gathered in a task.

Defined results: a null or empty text is a piece of one id, the end id; rows are documents of their own, so repeated rows or ids give repeated
pieces; long texts are encoded whole and cut; which of several pieces of one length goes where follows the order in which the pieces are
written, every choice being as good; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import gc
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import KEPT, keep_only, lean, materialize

CAPACITY = 2048
END_ID = 0
#: Pieces in a bucket within which pieces are numbered.
BUCKET = 250_000
CACHE_SIZE = 700_000
#: Marks a text's first part; no text has it, as it is half of a character.
FIRST = "\ud800"
#: Likewise marks a part that begins with a space and a line feed.
SPACED = "\ud801"
LINES = (FIRST, "\n")
#: Punctuation that is encoded apart from a letter before it.
ENDS = ".,;:!?"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts by the library, as little-endian unsigned 32-bit numbers.

    The library's pre-tokens take at most the one space before them, so a text may be cut before each space that follows
    something other than white space, and the ids of the parts joined. Likewise punctuation after a letter is a pre-token of its own, and so is
    a line feed alone between other characters than white space. Ids of parts are kept, so that only new ones are encoded. A text's first part is kept
    with a mark before it, one after a line feed with that, all others without their space.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # one letter of an id stands for one byte
        self.n_bytes[list(vocabulary.values())] = [len(token) for token in vocabulary]
        added = self.library.get_added_tokens_decoder()
        self.n_bytes[list(added)] = [len(token.content.encode()) for token in added.values()]

    @staticmethod
    def joined(cut: list[str]) -> list[str]:
        """The parts, where those after a part that is empty or ends in white space are joined to it."""
        out = cut[:1]
        after_space = cut[0] == FIRST or cut[0][-1].isspace()
        for part in cut[1:]:
            if after_space:
                out[-1] += " " + part
            else:
                out.append(SPACED + part if part[:1] == "\n" else part)
            after_space = part == "" or part[-1].isspace()
        return out

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], before: str) -> list[bytes]:
        """Ids of words with ``before`` (a space or line feed) before each, encoded one after another."""
        out: list[bytes] = []
        for s in range(0, len(words), 4096):
            text = before + before.join(words[s : s + 4096])
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            letters = np.frombuffer(text.encode(), np.uint8)
            begin = np.flatnonzero(letters == ord(before)) if len(words) > 1 else np.zeros(1, np.int64)
            at = 4 * np.searchsorted(np.cumsum(self.n_bytes[ids]), begin, side="right")
            raw, cuts = ids.tobytes(), [*at.tolist(), 4 * len(ids)]
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of parts, which are kept if they may be. Words are encoded many at a time, one after another, without the punctuation after them."""
        words, firsts, apart, ended = [], [], [], []
        for p in parts:
            if p.isalpha():
                words.append(p)
            elif (stem := p.rstrip(ENDS)).isalpha() and stem[-1] < "\u0250":  # letters in any version of Unicode
                ended.append((p, stem))
            elif p[:1] in LINES and p[1:].isalpha():
                firsts.append(p)
            else:
                apart.append(p)
        get = self.young.get
        words += {stem: None for _, stem in ended if get(stem) is None}.keys() - set(words)
        known = dict(zip(words, self._words(words, " "), strict=True))
        for p, ids in zip(firsts, self._words([p[1:] for p in firsts], "\n"), strict=True):
            known[p] = ids if p[0] == "\n" else ids[4:]  # without the line feed's
        ends = list(dict.fromkeys([p[len(stem) :] for p, stem in ended]))
        of_end = dict(zip(ends, self._library(ends), strict=True))
        for p, stem in ended:
            known[p] = (known.get(stem) or get(stem)) + of_end[p[len(stem) :]]
        self.young.update(known)
        whole = [p[1:] if p[:1] == FIRST else " " + p[1:] if p[:1] == SPACED else p if p[:1] == "\n" else " " + p for p in apart]
        found = dict(zip(apart, self._library(whole), strict=True))
        self.young.update((p, ids) for p, ids in found.items() if len(p) <= 64 and not p[-1:].isspace() and p not in ("", FIRST))
        return known | found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.young) >= CACHE_SIZE:
            self.old, self.young = self.young, {}
        get, old = self.young.get, self.old
        found: list[list[bytes | None]] = []
        gaps: list[tuple[list[bytes | None], list[int], list[str]]] = []
        missing: set[str] = set()
        for text in texts:
            cut = text.replace("\n", " \n").split(" ") if text else []
            if cut:
                cut[0] = FIRST + cut[0]
            ids = list(map(get, cut))
            if None in ids:
                at = [k for k, x in enumerate(ids) if x is None]
                if any(cut[k][-1:].isspace() or cut[k] in ("", FIRST) for k in at):  # such parts are never kept
                    cut = text.split(" ")
                    cut[0] = FIRST + cut[0]
                    cut = self.joined(cut)
                    ids = list(map(get, cut))
                    at = [k for k, x in enumerate(ids) if x is None]
                new = [cut[k] for k in at]
                gaps.append((ids, at, new))
                missing.update(new)
            found.append(ids)
        again = {p: ids for p in missing if (ids := old.get(p)) is not None}
        self.young.update(again)
        known = self._learn([*missing.difference(again)]) | again
        for ids, at, new in gaps:
            for k, p in zip(at, new, strict=True):
                ids[k] = known[p]
        return [b"".join(ids) for ids in found]


_loaded: dict[str, Encoder] = {}
KEPT["encoder"] = _loaded.clear


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` of each piece."""
    path = tokenizer or default_tokenizer()
    end = np.array([END_ID], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("encoder")
        encode = encoder(path).encode
        gc.disable()  # it makes millions of strings and no cycles
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                row, rows, own_ids = [], [], []
                for k, raw in enumerate(encode(part.column(1).to_pylist())):
                    raw += end
                    n = len(raw) // 4
                    stops = range(n % capacity or capacity, n + 1, capacity)
                    for i, stop in enumerate(stops):
                        start = max(0, stop - capacity) if i else 0
                        own = raw[4 * start : 4 * stop]
                        row.append(k)
                        rows.append((i, start, stop - start, zlib.crc32(own)))
                        own_ids.append(own)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                columns = [part.column(0).take(pa.array(row)), *columns]
                if ids:
                    flat = pa.array(np.frombuffer(b"".join(own_ids), "<u4").astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) // 4 for x in own_ids)]), pa.int32()), flat))
                yield pa.RecordBatch.from_arrays(columns, names)
        gc.enable()

    key = dict(df.dtypes)[id_col]
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(lean(run), f"doc_id {key}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(how many pieces of each length, how many sequences like that) for pieces of which there are so many of each length."""
    sizes = np.array(sorted(counts), np.int64)
    left = np.array([counts[s] for s in sizes.tolist()], np.int64)
    out = []
    while True:
        open_ = np.flatnonzero(left)
        if not len(open_):
            return out
        sizes, left = sizes[open_], left[open_]
        used: Counter[int] = Counter()
        gap, top, last = capacity, len(sizes), -1
        while (top := int(np.searchsorted(sizes[:top], gap, side="right"))) > 0:
            k = top - 1
            take = min(gap // int(sizes[k]), int(left[k]))  # the longest that fits, as often as it fits
            used[k] += take
            gap -= take * int(sizes[k])
            top, last = k, k
        need = used.copy()
        if gap and used.total() > 1:
            room = gap + int(sizes[last])
            free = left.copy()
            for k, c in used.items():
                free[k] -= c
            at = np.flatnonzero(free)
            have = sizes[at]
            second = np.searchsorted(have, room - have, side="right") - 1
            second -= (second == np.arange(len(have))) & (free[at] < 2)
            total = np.where(second >= 0, have + have[second], 0)
            if len(total) and total.max() > sizes[last]:
                x = int(total.argmax())
                used[last] -= 1
                used.update([int(at[x]), int(at[second[x]])])
                for k, c in used.items():
                    need[k] = max(need[k], c)
        used = Counter({k: c for k, c in used.items() if c})
        times = min((int(left[k]) - need[k]) // c + 1 for k, c in used.items())
        for k, c in used.items():
            left[k] -= c * times
        out.append(({int(sizes[k]): c for k, c in sorted(used.items(), reverse=True)}, times))


def _places(patterns: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """(length << 40 | first number, pieces of the length in a sequence, first sequence, offset of the first of them), in order."""
    given: Counter[int] = Counter()
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for size, c in pattern.items():
            rows.append(((size << 40) | given[size], c, sequence, offset))
            given[size] += c * times
            offset += c * size
        sequence += times
    return tuple(np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else tuple(np.empty(0, np.int64) for _ in range(4))


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``. The result reads a table in the shared folder (its ``scratch_path``)."""
    spark = df.sparkSession
    found = materialize(pieces(df, id_col, text_col, tokenizer, capacity, ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    places = spark.sparkContext.broadcast(_places(best_two_fit(counts, capacity)))
    buckets = sum(counts.values()) // BUCKET + 1
    numbered = found.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    of = ["length", "bucket"]
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = numbered.groupBy(*of).agg(F.count("*").alias("n")).select(*of, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = numbered.withColumn("number", F.row_number().over(Window.partitionBy(*of).orderBy("row")) - 1)
    numbered = numbered.join(firsts, of).withColumn("number", F.col("number") + F.col("first"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        keys, times, sequence, offset = places.value
        for batch in batches:
            length, number = (np.asarray(batch.column(k)) for k in (0, 1))
            key = (length << 40) | number
            at = np.searchsorted(keys, key, side="right") - 1
            k = key - keys[at]
            own = [sequence[at] + k // times[at], offset[at] + k % times[at] * length]
            yield pa.RecordBatch.from_arrays([batch.column(2), *(pa.array(x) for x in own)], ["p", "sequence_id", "offset"])

    columns = [c for c in found.columns if c != "row"]
    kind = found.select(F.struct(*columns).alias("p")).schema["p"].dataType.simpleString()
    out = numbered.select("length", "number", F.struct(*columns).alias("p")).mapInArrow(lean(place), f"p {kind}, sequence_id long, offset long").select("p.*", "sequence_id", "offset")
    out.scratch_path = found.scratch_path
    return out


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids, pieces``: the pieces of each sequence put together, at most ``CAPACITY`` ids."""
    whole = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("of"))
    ids = F.flatten("of.ids")
    return whole.select("sequence_id", F.size(ids).alias("n_tokens"), ids.alias("ids"), F.transform("of", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"))).alias("pieces"))
