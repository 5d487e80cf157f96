"""Operator 12: collocations, phrases whose words stand together more often than they would alone, by counting quotient filters.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends and those into words. Within each language, phrases of 2 to ``LONGEST`` words
that occur ``LEAST`` times are scored by their weakest cut; phrases that stand mostly inside a longer one are dropped.

Counting. Words that occur ``LEAST`` times in a language are numbered; no other word can be part of a candidate. A phrase is the numbers of
its words side by side, which a Feistel network permutes: nothing is lost, and phrases are spread evenly. The permuted number's high
bits are its *quotient*, all others its *remainder*. Each task keeps the phrases that it has seen in a filter in that order, and writes it
down by quotients: one bit for each slot and entry tells which entries share a quotient, and an entry is its remainder
and its count, in one byte if the count is small. Filters are cut by their first bits into sections of bounded size; a section's filters are merged by
their order, counts added, and what reaches ``LEAST`` is permuted back into words. No task holds more than a section, and no phrase is a hot key: of
each filter it is one entry, whatever its count.

Numbers of words. The ``TOP`` most frequent words of at most ``TOP_BYTES`` bytes are broadcast (16 MB at most); numbers of other words, if there are any,
are joined to the texts that have them.

Defined results: a null text counts as empty; a null language is the language ``und``; rows are documents of their own, so repeated rows count
repeatedly; texts are taken whole; equal scores are ordered by count, then phrase (by bytes); an empty table gives an empty result. Other columns
are not looked at. Arithmetic with counts is done in decimals.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, keep_only, lean, materialize
from .shingles import mix

LEAST, LONGEST = 30, 4
FIRST = 2000
TOP, TOP_BYTES = 1 << 18, 64
#: Most occurrences that a section of the filters is planned for, entries that a task gathers, and occurrences that it sorts at once.
SECTION, FILTER, SORTED = 1 << 20, 1 << 20, 1 << 20
#: Different words that a task counts before it hands them on.
WORDS = 300_000
#: Phrases, or words, within which such are numbered or ranked.
BUCKET = 100_000
#: Characters that end pieces become line feeds, tabulators spaces, A-Z lower-case letters.
LETTERS = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
ROUNDS = 4


def tokens(text: str | None) -> list[bytes]:
    """Words, with a line feed where a piece ends. Empty ones stand between spaces."""
    return (text or "").encode().translate(LETTERS).replace(b"\n", b" \n ").split(b" ")


def word_counts(df: DataFrame) -> DataFrame:
    """``lang, word, f``. df: lang, text"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        seen: dict[str, Counter[bytes]] = {}

        def flush() -> pa.RecordBatch:
            langs = [lang for lang, own in seen.items() for _ in own]
            words = pa.array([w for own in seen.values() for w in own], pa.binary()).cast(pa.string())
            counts = [c for own in seen.values() for c in own.values()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), words, pa.array(counts, pa.int64())], ["lang", "word", "f"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = seen.setdefault(lang, Counter())
                own.update(tokens(text.as_py()))
                del own[b""], own[b"\n"]
                if len(own) > WORDS // len(seen):
                    yield flush()
        yield flush()

    return df.mapInArrow(lean(run), "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def numbered(words: DataFrame, n: int) -> DataFrame:
    """``id`` from 1 beside the columns of ``words``, of which there are ``n`` rows; within buckets and by running totals over buckets."""
    words = words.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(n // BUCKET + 1)))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = words.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "word"))
    return words.withColumn("own", own).join(firsts, "bucket").select((F.col("own") + F.col("first")).alias("id"), "lang", "word", "f")


class Packing:
    """Phrases of numbers up to ``largest`` as permuted numbers of two words: the first up to 64 bits and the rest."""

    def __init__(self, largest: int):
        self.bits = max(1, int(largest).bit_length())
        self.half = 2 * self.bits
        self.high = min(64, 2 * self.half)
        self.low = 2 * self.half - self.high
        self.mask = np.uint64((1 << self.half) - 1)

    def pack(self, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        b = np.uint64(self.bits)
        left, right = (numbers[0] << b) | numbers[1], (numbers[2] << b) | numbers[3]
        for k in range(ROUNDS):
            left, right = right, left ^ (mix(right, k + 1) & self.mask)
        if not self.low:
            return (left << np.uint64(self.half)) | right, np.zeros(0, np.uint64)
        shift = np.uint64(self.low)
        return (left << np.uint64(64 - self.half)) | (right >> shift), right & np.uint64((1 << self.low) - 1)

    def unpack(self, high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
        if not self.low:
            left, right = high >> np.uint64(self.half), high & self.mask
        else:
            left, right = high >> np.uint64(64 - self.half), ((high << np.uint64(self.low)) | low) & self.mask
        for k in range(ROUNDS - 1, -1, -1):
            left, right = right ^ (mix(left, k + 1) & self.mask), left
        b, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        return [left >> b, left & mask, right >> b, right & mask]


def summed(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order, equal ones added up. ``counts``: one each if missing."""
    if not len(low):
        if counts is None:
            high = np.sort(high)
        else:
            order = np.argsort(high, kind="stable")  # merges what is in order already
            high, counts = high[order], counts[order]
        new = np.r_[True, high[1:] != high[:-1]]
    else:
        order = np.argsort(high, kind="stable")
        high, low = high[order], low[order]
        same = high[1:] == high[:-1]
        mixed = np.flatnonzero(same & (low[1:] != low[:-1]))  # only where the first 64 bits are equal, the rest decides
        if len(mixed):
            group = np.cumsum(np.r_[0, ~same])
            at = np.flatnonzero(np.isin(group, group[mixed]))
            by = at[np.lexsort((low[at], group[at]))]
            low[at], order[at] = low[by], order[by]
        counts = counts[order] if counts is not None else None
        new = np.r_[True, ~same | (low[1:] != low[:-1])]
    starts = np.flatnonzero(new[: len(high)])
    total = np.diff(np.r_[starts, len(high)]) if counts is None else np.add.reduceat(counts, starts) if len(starts) else counts
    return high[starts], low[starts] if len(low) else low, total.astype(np.int64)


def write_filter(packing: Packing, section_bits: int, high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
    """(section, entries, quotient bits, slots and entries by bits, remainders, counts, large counts) of each section with entries."""
    q = min(packing.high, max(section_bits, len(high).bit_length() - 1))
    rest = packing.high - q
    quotient = (high >> np.uint64(rest)).astype(np.int64) if rest < 64 else np.zeros(len(high), np.int64)
    section = quotient >> (q - section_bits)
    edges = np.flatnonzero(np.r_[True, section[1:] != section[:-1], True])
    wide = [high.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-rest // 8)]]
    if packing.low:
        wide.append(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-packing.low // 8)])
    remainder = np.concatenate(wide, axis=1)
    if rest % 8:
        remainder[:, rest // 8] &= (1 << rest % 8) - 1
    small = np.minimum(counts, 255).astype(np.uint8)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = quotient[a:b] & ((1 << (q - section_bits)) - 1)
        bits = np.zeros((1 << (q - section_bits)) + b - a, np.uint8)
        bits[own + np.arange(b - a)] = 1
        yield int(section[a]), b - a, q, np.packbits(bits).tobytes(), remainder[a:b].tobytes(), small[a:b].tobytes(), counts[a:b][small[a:b] == 255].astype("<i8").tobytes()


def read_filter(packing: Packing, section_bits: int, section: int, n: int, q: int, bits: bytes, remainders: bytes, small: bytes, large: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What :func:`write_filter` was given, of one section."""
    rest = packing.high - q
    slots = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))[:n] - np.arange(n)
    quotient = slots.astype(np.uint64) + np.uint64(section << (q - section_bits))
    wide = np.frombuffer(remainders, np.uint8).reshape(n, -1)
    first = -(-rest // 8)
    parts = []
    for columns in (wide[:, :first], wide[:, first:]):
        eight = np.zeros((n, 8), np.uint8)
        eight[:, : columns.shape[1]] = columns
        parts.append(eight.view("<u8").ravel().astype(np.uint64))
    high = (quotient << np.uint64(rest)) | parts[0] if rest < 64 else parts[0]
    counts = np.frombuffer(small, np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(large, "<i8")
    return high, parts[1] if packing.low else np.zeros(0, np.uint64), counts


def counted_phrases(docs: DataFrame, vocabulary: DataFrame, n_words: int, n_tokens: int, least: int = LEAST) -> DataFrame:
    """``ids, a``: the phrases that occur ``least`` times, as numbers of their words. docs: lang, text; vocabulary: id, lang, word, f"""
    spark = docs.sparkSession
    packing = Packing(n_words)
    section_bits = min((3 * n_tokens // SECTION).bit_length(), packing.half)
    short = vocabulary.where(F.octet_length("word") <= TOP_BYTES)
    top = short if n_words <= TOP else short.orderBy(F.desc("f"), "id").limit(TOP)
    found = top.select("lang", "word", "id").toArrow()  # bounded by TOP and TOP_BYTES
    tables: dict[str, dict[bytes, int]] = {}
    for lang, word, i in zip(*(found.column(k).to_pylist() for k in range(3)), strict=True):
        tables.setdefault(lang, {b"": -1, b"\n": 0})[word.encode()] = i
    shared = spark.sparkContext.broadcast(tables)
    if found.num_rows < n_words:
        docs = with_other_numbers(docs, vocabulary, top.select("id"), shared)
    else:
        docs = docs.withColumn("more", F.lit(None).cast("array<struct<word:string,id:long>>"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        names = ["section", "n", "q", "bits", "remainders", "small", "large"]
        types = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        none = {b"": -1, b"\n": 0}
        kept = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        texts: list[np.ndarray] = []
        held = 0

        def add() -> None:
            """Sort the phrases of the texts held and add them to those kept."""
            nonlocal kept, held
            ids = np.concatenate([*texts, np.zeros(LONGEST, np.int64)])
            texts.clear()
            held = 0
            ids = ids[ids >= 0].astype(np.uint64)
            m = len(ids) - LONGEST + 1
            whole = ids[:m] > 0
            parts = []
            for size in range(2, LONGEST + 1):
                whole = whole & (ids[size - 1 : size - 1 + m] > 0)
                at = np.flatnonzero(whole)
                nothing = np.zeros(len(at), np.uint64)
                parts.append([ids[at + k] if k < size else nothing for k in range(LONGEST)])
            new = summed(*packing.pack([np.concatenate(x) for x in zip(*parts, strict=True)]), None)
            kept = summed(*(np.concatenate(x) for x in zip(kept, new, strict=True))) if len(kept[0]) else new

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal kept
            rows: list[tuple] = []
            size = 0
            for row in write_filter(packing, section_bits, *kept) if len(kept[0]) else ():
                rows.append(row)
                size += sum(map(len, row[3:]))
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            kept = (kept[0][:0], kept[1][:0], kept[2][:0])

        for batch in batches:
            for lang, text, more in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                get = shared.value.get(lang, none).get
                own = tokens(text.as_py())
                numbers = [get(w, 0) for w in own]
                if more.is_valid:  # few words beside the table, which is not copied for them
                    other = {x["word"].encode(): x["id"] for x in more.as_py()}.get
                    numbers = [n or other(w, 0) for n, w in zip(numbers, own, strict=True)]
                texts += [np.fromiter(numbers, np.int64, len(own)), np.zeros(1, np.int64)]
                held += len(own)
                if held > SORTED // 2:
                    add()
                    if len(kept[0]) > FILTER:
                        yield from flush()
        if texts:
            add()
        yield from flush()

    filters = docs.select("lang", "text", "more").mapInArrow(lean(count), "section long, n int, q int, bits binary, remainders binary, small binary, large binary")

    def merge(section: pa.Table) -> pa.Table:
        keep_only()
        of = [read_filter(packing, section_bits, *row.values()) for row in section.to_pylist()]
        high, low, counts = summed(*(np.concatenate(x) for x in zip(*of, strict=True)))
        enough = np.flatnonzero(counts >= least)
        ids = np.stack(packing.unpack(high[enough], low[enough] if packing.low else low), 1).astype(np.int64)
        flat, size = ids.ravel(), (ids > 0).sum(1)
        arrays = pa.ListArray.from_arrays(pa.array(np.cumsum(np.r_[0, size]), pa.int32()), pa.array(flat[flat > 0]))
        return pa.table([arrays, pa.array(counts[enough])], ["ids", "a"])

    return filters.groupBy("section").applyInArrow(merge, "ids array<long>, a long")


def with_other_numbers(docs: DataFrame, vocabulary: DataFrame, top: DataFrame, shared) -> DataFrame:
    """``lang, text, more``: the words of each text that have a number but aren't among those in ``top``, with their numbers."""
    docs = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "numbered_docs")
    others = vocabulary.join(top, "id", "left_anti").select("id", "lang", "word")

    none = {b"": -1, b"\n": 0}

    def rows(batch: pa.RecordBatch, at: list[int], found: list[bytes]) -> pa.RecordBatch:
        own = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(found, pa.binary()).cast(pa.string())], ["row", "lang", "word"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in batches:
            at, found = [], []
            for k, (lang, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                table = shared.value.get(lang, none)
                own = [w for w in set(tokens(text.as_py())) if w not in table]
                at += [k] * len(own)
                found += own
                if len(found) > WORDS:
                    yield rows(batch, at, found)
                    at, found = [], []
            if found:
                yield rows(batch, at, found)

    seen = docs.select("row", "lang", "text").mapInArrow(lean(words), "row long, lang string, word string")
    more = seen.join(others, ["lang", "word"]).groupBy("row").agg(F.collect_list(F.struct("word", "id")).alias("more"))
    return docs.join(more, "row", "left")


def phrases(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of the phrases that stay. The result reads tables in the shared folder."""
    docs = df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = materialize(word_counts(docs), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    sums = words.agg(F.sum("f"), F.count_if(F.col("f") >= least)).first()
    vocabulary = materialize(numbered(words.where(F.col("f") >= least), sums[1]), "vocabulary")
    found = materialize(counted_phrases(docs, vocabulary, sums[1], sums[0] or 0, least), "phrases")
    parts = found.select("ids", F.col("a").alias("f")).unionByName(vocabulary.select(F.array("id").alias("ids"), "f"))
    part = lambda first, n, name: F.slice("ids", first, n).alias(name)
    cuts = found.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", part(F.lit(1), F.col("k"), "left"), part(F.col("k") + 1, F.size("ids") - F.col("k"), "right"))
    cuts = cuts.join(parts.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left").join(parts.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = cuts.groupBy("ids", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ids") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("ids") - n + 1), lambda k: F.slice("ids", k, n))))
    longer = found.where(F.size("ids") > 2).select(F.explode(inside).alias("ids"), F.col("a").alias("longest")).groupBy("ids").agg(F.max("longest").alias("longest"))
    mostly = F.expr("cast(100 as decimal(3,0)) * cast(longest as decimal(19,0)) >= cast(80 as decimal(3,0)) * cast(a as decimal(19,0))")
    kept = scored.join(longer, "ids", "left").where(~F.coalesce(mostly, F.lit(False)))
    letters = kept.select("ids", F.posexplode("ids").alias("at", "id")).join(vocabulary.select("id", "lang", "word"), "id")
    spelled = letters.groupBy("ids").agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    spelled = spelled.select("ids", "lang", F.array_join("words.word", " ").alias("phrase"))
    out = kept.join(spelled, "ids").join(totals, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    out.scratch_tables = [words, vocabulary, found]
    return out


def first_phrases(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, first: int = FIRST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's ``first`` phrases; ranked in parts of each language before they meet."""
    found = phrases(df, lang_col, text_col, least)
    tables = found.scratch_tables
    found = materialize(found, "collocations")
    discard(*tables)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = found.count() // BUCKET + 1
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
    few = found.withColumn("own", F.row_number().over(part)).where(F.col("own") <= first)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PHRASES_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, {_LOWER} AS t FROM documents),
pieces AS (SELECT d, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
lists AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
grams AS (SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4], lambda n: list_transform(range(1, len(ws) - n + 2), lambda i: ws[i : i + n - 1])))) AS g FROM lists),
counts AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE len(g) = 1 GROUP BY lang),
cand AS (SELECT lang, g, f AS a FROM counts WHERE len(g) > 1 AND f >= {LEAST}),
cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM cand),
scored AS (SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f))::BIGINT AS score
 FROM cuts c JOIN counts x ON x.lang = c.lang AND x.g = c.g[1 : c.k] JOIN counts y ON y.lang = c.lang AND y.g = c.g[c.k + 1 : len(c.g)]),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_ AS (SELECT lang, a, unnest(flatten(list_transform(range(2, len(g)), lambda n: list_transform(range(1, len(g) - n + 2), lambda i: g[i : i + n - 1])))) AS g FROM cand WHERE len(g) > 2),
longer AS (SELECT lang, g, max(a) AS longest FROM inner_ GROUP BY lang, g),
kept AS (SELECT s.* FROM least s LEFT JOIN longer o ON o.lang = s.lang AND o.g = s.g WHERE o.longest IS NULL OR 100::HUGEINT * o.longest < 80::HUGEINT * s.a),
spelled AS (SELECT k.lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM kept k JOIN totals USING (lang))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM spelled QUALIFY rank <= {FIRST}
"""
