"""Periodic runs, collocations and packing against plain loops, on small tables, odd rows and the given tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from delspan.llm import collocations, packing, periodic_runs
from tests.compare import SF

DOCS = "doc_id long, text string, lang string, row string, runs int, p int, n long"


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


# ---- periodic runs


def test_runs_equal_comparing_all_words():
    rng = random.Random(3)
    docs = []
    for _ in range(3000):
        letters, n = rng.choice([1, 2, 3, 5]), rng.randrange(60)
        w = [bytes([97 + rng.randrange(letters)]) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 3))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        docs.append(w)
    for least, times in ((6, 4), (2, 2), (9, 3)):
        found = [[tuple(r) for r in x.tolist()] for x in periodic_runs.runs_of(docs, least, times)]
        assert found == [periodic_runs.brute_force(w, least, times) for w in docs]


def test_runs_of_long_periods_and_one_word():
    w = [str(k % 4001).encode() for k in range(20_000)]
    assert periodic_runs.runs_of([w, [b"x"] * 30_000, [b"x"] * 5])[0].tolist() == [[0, 20_000, 4001]]
    assert [r.tolist() for r in periodic_runs.runs_of([[b"x"] * 30_000, [b"x"] * 5])] == [[[0, 30_000, 1]], []]


def rewritten(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected_runs(doc_id, text):
    words = words_of(text)
    if doc_id is not None:
        words = rewritten(doc_id, words)
    runs = periodic_runs.brute_force(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def digests(found):
    return [tuple(r)[:8] for r in found.collect()]


def test_run_digests_of_whole_table_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = digests(periodic_runs.run_digests(docs))
    expected = [expected_runs(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(found) == sorted(expected)
    assert any(r[1] for r in found)


def test_run_digests_of_odd_rows(spark):
    texts = [None, "", " \t\n", "a", "a b " * 9, "a b " * 9, "x\x85x x\x85x " * 6, "é\xa0é " * 40, "z " * 50_000, "\x1c \x1c " * 5]
    rows = [(k, t, None, "r", 1, 2, 3) for k, t in enumerate(texts)] + [(None, "q q q q q q q", "en", None, None, None, None), (4, "a b " * 9, "en", "r", 1, 2, 3)]
    rows += [(k, f"{k} b c d e f g h i j k l m n o p q r s t", None, None, None, None, None) for k in range(100, 140)]
    found = digests(periodic_runs.run_digests(spark.createDataFrame(rows, DOCS)))
    assert Counter(found) == Counter(expected_runs(r[0], r[1]) for r in rows)
    assert periodic_runs.run_digests(spark.createDataFrame([], DOCS)).count() == 0


def test_periodic_runs_keeps_other_columns(spark):
    docs = spark.createDataFrame([(1, "b a b a b a b a c", "en", "r", 5, 6, 7)], DOCS)
    row = periodic_runs.periodic_runs(docs).first()
    assert row["row"]["runs"] == 5 and row["row"]["row"] == "r"
    assert [tuple(r) for r in row.runs] == [(0, 8, 2)] and row.collapsed == "b a c"


# ---- collocations


def expected_phrases(rows, least, first):
    counts = defaultdict(Counter)
    for lang, text in rows:
        lower = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(rb"[^\x20\x09]+", piece)
            for n in range(1, 5):
                counts[lang or "und" if lang is None else lang].update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        cand = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        longest = Counter()
        for g, c in cand.items():
            for size in range(2, len(g)):
                for k in range(len(g) - size + 1):
                    longest[g[k : k + size]] = max(longest[g[k : k + size]], c)
        kept = []
        for g, a in cand.items():
            if 100 * longest[g] >= 80 * a:
                continue
            score, _, left, right = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            kept.append((-score, -a, b" ".join(g), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n, -s) for k, (s, a, p, left, right) in enumerate(sorted(kept)[:first], 1)]
    return sorted(out)


@pytest.mark.parametrize("top", [1 << 18, 3])
def test_first_phrases_equal_plain_counts(spark, monkeypatch, top):
    monkeypatch.setattr(collocations, "TOP", top)  # beyond it, numbers are joined
    monkeypatch.setattr(collocations, "BUCKET", 50)
    rng = random.Random(5)
    letters = ["a", "B", "c", "dé", "É", "ß", "x" * 70, "y\x85y", "日本"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(letters) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "!", "\x0b"]) for _ in range(rng.randrange(80)))) for _ in range(60)]
    rows += [("en", None), ("en", ""), (None, "...")] + [("fr", "le petit chat dort")] * 40 + [("fr", "q " * 30_000)]
    docs = spark.createDataFrame([(1, t, lang, "r", 1, 2, 3) for lang, t in rows], DOCS)
    for least, first in ((30, 2000), (4, 15)):
        found = sorted(map(tuple, collocations.first_phrases(docs, least=least, first=first).collect()))
        assert found == expected_phrases(rows, least, first)


def test_first_phrases_of_no_rows_or_no_words(spark):
    assert collocations.first_phrases(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.first_phrases(spark.createDataFrame([(1, None, None, None, None, None, None)], DOCS)).count() == 0


def test_small_tasks_and_sections_give_the_same_phrases(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = sorted(map(tuple, collocations.phrases(docs, least=10).collect()))
    for name, size in (("SECTION", 1 << 12), ("FILTER", 1 << 10), ("SORTED", 1 << 9)):
        monkeypatch.setattr(collocations, name, size)
    assert sorted(map(tuple, collocations.phrases(docs, least=10).collect())) == before


@pytest.mark.parametrize("largest", [1, 200, 65_535, 70_000, 2**25, 2**32 - 1])
def test_filters_lose_nothing(largest):
    rng = np.random.default_rng(largest)
    packing_ = collocations.Packing(largest)
    numbers = [rng.integers(0, largest + 1, 5000, np.uint64) for _ in range(4)]
    numbers = [np.r_[x, x[:900], np.uint64(largest)] for x in numbers]
    high, low = packing_.pack(numbers)
    assert all((x == y).all() for x, y in zip(packing_.unpack(high, low), numbers, strict=True))
    high, low, counts = collocations.summed(high, low, None)
    counts[:3] = [254, 255, 10**12]
    expected = Counter(zip(*(x.tolist() for x in packing_.unpack(high, low)), strict=True))
    assert set(expected) == set(zip(*(x.tolist() for x in numbers), strict=True))
    back = [collocations.read_filter(packing_, 2, *row) for row in collocations.write_filter(packing_, 2, high, low, counts)]
    assert all((np.concatenate(x) == y).all() for x, y in zip(zip(*back, strict=True), (high, low, counts), strict=True))


def test_summed_decides_by_the_rest_where_first_bits_are_equal():
    high = np.array([5, 5, 1, 5, 5], np.uint64)
    low = np.array([2, 1, 7, 2, 1], np.uint64)
    for counts in (None, np.array([1, 10, 100, 1000, 10_000])):
        found = [x.tolist() for x in collocations.summed(high, low, counts)]
        assert found == [[1, 5, 5], [7, 1, 2], [1, 2, 2] if counts is None else [100, 10_010, 1001]]


# ---- packing


def plain_best_two_fit(lengths, capacity):
    """Piece by piece."""
    left = Counter(lengths)
    out = []
    while left:
        bin_, gap = [], capacity
        while fits := [s for s in left if s <= gap]:
            s = max(fits)
            bin_.append(s)
            gap -= s
            left[s] -= 1
            left = +left
        s = min(bin_)
        if gap and len(bin_) > 1:
            pairs = [(x + y, x, y) for x in left for y in left if x + y <= gap + s and (x != y or left[x] > 1)]
            best = max(pairs, default=(0, 0, 0))
            if best[0] > s:
                bin_.remove(s)
                bin_ += best[1:]
                left[s] += 1
                left.subtract(best[1:])
                left = +left
        out.append(bin_)
    return out


def test_patterns_equal_packing_piece_by_piece():
    rng = random.Random(7)
    for capacity in (7, 20, 64):
        for _ in range(60):
            lengths = [rng.randint(1, rng.choice([capacity, capacity // 2, capacity // 3])) for _ in range(rng.randrange(120))]
            patterns = packing.best_two_fit(Counter(lengths), capacity)
            plain = plain_best_two_fit(lengths, capacity)
            assert Counter(x for pattern, times in patterns for size, c in pattern.items() for x in [size] * (c * times)) == Counter(lengths)
            assert all(sum(size * c for size, c in pattern.items()) <= capacity for pattern, _ in patterns)
            assert sum(times for _, times in patterns) == len(plain)


def test_two_documents_replace_one():
    # greedily 6+3 leave a gap of 1; 2+2 fill what the 3 leaves
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == ({6: 1, 2: 2}, 1)


def assert_packed(found, expected, capacity=2048):
    """found: rows of the query; expected: (doc_id, piece, start, length, crc)"""
    assert Counter(tuple(r)[:5] for r in found) == Counter(expected)
    of = defaultdict(list)
    for r in found:
        of[r.sequence_id].append((r.offset, r.length))
    for own in of.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(of) == len(plain_best_two_fit([r[3] for r in expected], capacity))
    return of


def expected_pieces(rows, capacity=2048):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_tokenizer())
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % capacity or capacity
        edges = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            yield doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())


def test_whole_table_is_packed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    of = assert_packed(packing.pack(docs, ids=False).collect(), [*expected_pieces(rows)])
    total = sum(length for own in of.values() for _, length in own)
    assert len(of) <= 1.01 * total / packing.CAPACITY + 1


def test_odd_rows_are_packed(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 5)
    texts = [None, "", " ", "a  b", "<|endoftext|>", "x <|endoftext|>y", "word " * 30_000, "é\xa0ü " * 9, "\x1c a \n b", "a" * 5000]
    rows = [(k % 7, t, None, "r", 1, 2, 3) for k, t in enumerate(texts * 3)] + [(None, "hello there", "en", None, None, None, None)] * 40
    docs = spark.createDataFrame(rows, DOCS)
    expected = [*expected_pieces([r[:2] for r in rows])]
    assert_packed(packing.pack(docs, ids=False).collect(), expected)
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_sequences_hold_the_ids(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_tokenizer())
    docs = spark.createDataFrame([(k, "one two three " * (k * 7)) for k in range(1, 30)], "doc_id long, text string")
    rows = packing.sequences(packing.pack(docs, capacity=256)).collect()
    assert all(r.n_tokens == len(r.ids) <= 256 for r in rows)
    texts = defaultdict(dict)
    for r in rows:
        ends = [*(p.offset for p in r.pieces), r.n_tokens]
        for k, p in enumerate(r.pieces):
            texts[p.doc_id][p.piece] = r.ids[ends[k] : ends[k + 1]]
    for k, own in texts.items():
        ids = [i for piece in sorted(own) for i in own[piece]]
        assert ids == [*library.encode("one two three " * (k * 7), add_special_tokens=False).ids, 0]


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(packing.default_tokenizer()), packing.Encoder(packing.default_tokenizer())
    rng = random.Random(1)
    some = ["a", " ", "\n", "  ", "'s", "é", "1", ".", ", ", "\xa0", "\x1c", "<|endoftext|>", "\t", "　", "日", "don't ", "Word, "]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(14))) for _ in range(8000)]
    for s in range(0, len(texts), 500):
        part = texts[s : s + 500]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(part)] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


def test_repeated_lengths_are_numbered_without_gaps(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    found = packing.pack(docs, ids=False)
    assert found.select("sequence_id", "offset").distinct().count() == 3000
