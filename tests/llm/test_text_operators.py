"""Language identification, token counts, mixing, repeats, encoding and the similarity join against brute force, with odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps, PandasGroupedOpsMixin

from delspan.llm import language_id, mixing, ngram_join, sentencepiece_bpe, suffix_dedup, suffix_sorting, token_counts
from delspan.llm.queries import ORACLES, QUERIES
from delspan.llm.shingles import shingle_set
from tests.compare import SF, assert_same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, row string, at string, spans int"


def docs(spark, texts, ids=None, langs=None, sources=None):
    """Rows with extra columns whose names the operators use themselves."""
    rows = [(i if ids is None else ids[i], t, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], len(t or ""), "x", "y", "z", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def sentence(rng, n=40, words=300):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


ODD = [None, "", " ", "\n\t", "a", "a", "B b", "x" * 9000, "é 日本 😀 \x00 ▁ <s>", "word  two   spaces\r\n"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())


def test_encoding_equals_the_library(spark, library):
    rng = random.Random(1)
    alphabet = "ab the in er  ▁\n\t\r,.;()-=/0123é日😀\u200bß\x00<>sunk"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    got = {r.doc_id: r for r in sentencepiece_bpe.encode_decode(docs(spark, texts)).collect()}
    counts = {r.doc_id: r for r in token_counts.count_tokens(docs(spark, texts), limit=20).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "")
        assert got[i].ids == ids and got[i].decoded == library.decode(ids), t
        assert (counts[i].n_tokens, counts[i].n_bytes, counts[i].over_limit) == (len(ids), len((t or "").encode()), len(ids) > 20)


def test_encoding_query(spark, library):
    got = {r.doc_id: r for r in QUERIES["op9_sentencepiece"](spark, SF).collect()}
    counts = {r.doc_id: r.n_tokens for r in QUERIES["op3_token_counts"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(r.text)
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert counts[r.doc_id] == len(ids)


def test_decoding_invalid_bytes(library):
    model = sentencepiece_bpe.load(sentencepiece_bpe.default_model())
    rng = random.Random(2)
    for _ in range(300):
        ids = [rng.choice([*model.byte_of, 28705, 264, 13]) for _ in range(rng.randrange(8))]
        assert model.decode(ids) == library.decode(ids)


def test_mixing_query_equals_sql(spark):
    assert_same(QUERIES["op5_source_mixing"](spark, SF), ORACLES["op5_source_mixing"])


def test_mixing_repeats_no_document_beyond_its_epochs(spark):
    texts = ["a b c d e"] * 400 + ["x"] + [""] * 300
    rows = mixing.mixed(docs(spark, texts, [*range(len(texts))], sources=["a"] * 400 + ["b"] * 301)).collect()
    most = {s: max(r.times for r in rows if r.row.source == s) for s in "ab"}
    assert {r.target / r.source_size for r in rows if r.row.source == "b"} == {2.0} and most["b"] == 2 and most["a"] <= 2


def test_mixing_odd_rows(spark):
    rng = random.Random(3)
    texts = [None, "", *(sentence(rng, rng.randrange(1, 30)) for _ in range(300)), "one two", "one two"]
    ids = [*range(len(texts) - 2), 7000, 7000]
    sources = [rng.choice(["a", "b", "B", None]) for _ in texts]
    rows = mixing.taken_words(docs(spark, texts, ids, sources=sources)).collect()
    again = mixing.taken_words(docs(spark, texts, ids, sources=sources).repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    total = sum(r["size"] for r in rows)
    targets = {(r.source_size, r.target) for r in rows}
    assert sum(t for _, t in targets) == pytest.approx(1.5 * total) and all(t <= 2 * s + 1e-9 for s, t in targets)
    for s, t in targets:
        assert abs(sum(r.taken for r in rows if r.source_size == s) - t) <= 30
    assert all(r.taken <= 2 * r["size"] for r in rows)
    mixed = mixing.mix_documents(docs(spark, texts, ids, sources=sources))
    assert mixed.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert mixing.taken_words(docs(spark, [])).count() == 0
    assert [tuple(r) for r in mixing.taken_words(docs(spark, [None, ""])).select("size", "target", "taken").collect()] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("weights, sizes", [((3, 1, 2), [5, 0, 900, 40, 7]), ((1,), [10, 10]), ((3, 1, 2), [1000, 1, 1, 1])])
def test_water_filling_equals_resharing(spark, weights, sizes):
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long"), weights).collect()}
    w = {f"s{i}": weights[i % len(weights)] for i in range(len(sizes))}
    cap = {f"s{i}": 2.0 * n for i, n in enumerate(sizes)}
    full: dict = {}
    while True:  # clamp, reshare, until none is above
        left = 1.5 * sum(sizes) - sum(full.values())
        share = {s: left * w[s] / sum(w[o] for o in w if o not in full) for s in w if s not in full}
        above = [s for s in share if share[s] >= cap[s]]
        if not above:
            break
        full |= {s: cap[s] for s in above}
        if len(full) == len(w):
            break
    assert got == pytest.approx({**share, **full})


def test_language_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    rows = QUERIES["op1_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    rng = random.Random(4)
    texts = ["the cat and the dog " * 5] * 5 + ["der hund und die katze " * 5] * 5 + [None, "", "123 !?", "the", "the the", "the the"]
    langs = ["en"] * 5 + ["de"] * 5 + [None] * 6
    found = {r.doc_id: r for r in language_id.identify(docs(spark, texts, langs=langs)).collect()}
    assert [found[k].lang_pred for k in (10, 11, 12)] == ["und"] * 3 and found[10].score == 0
    assert found[13].lang_pred == "en" and found[14].lang_pred == "en" and found[0].lang_pred == "en" and found[9].lang_pred == "de"
    kept = language_id.keep_identified(docs(spark, texts, langs=langs))
    assert sorted(r.doc_id for r in kept.collect()) == [*range(10), 13, 14, 15] and len(kept.columns) == 9
    assert {r.lang_pred for r in language_id.identify(docs(spark, ["some text"], langs=[None])).collect()} == {"und"}  # nothing learned
    assert [r.text for r in language_id.keep_identified(docs(spark, ["some text", "12"], langs=[None] * 2)).collect()] == ["some text"]
    long = language_id.identify(docs(spark, [*texts, "der hund und " * 200_000], langs=[*langs, None])).where("doc_id = 16").first()
    assert long.lang_pred == "de"
    tied = language_id.identify(docs(spark, ["same words here"] * 40, langs=["zz", "aa"] * 20)).collect()
    assert {r.lang_pred for r in tied} == {"aa"}  # equal prototypes: the first label
    assert language_id.identify(docs(spark, [])).count() == 0
    assert rng


def plain_profile(text):
    """A profile letter by letter, with exact sums."""
    letters = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    letters = re.sub(" +", " ", letters)
    counts = collections.Counter(letters[k : k + 3] for k in range(len(letters) - 2))
    v = lambda c: language_id.letter_vector(0 if c == " " else ord(c)).astype(float)
    return sum(n**0.5 * np.roll(v(g[0]), 2) * np.roll(v(g[1]), 1) * v(g[2]) for g, n in counts.items())


def test_language_equals_plain_profiles(spark):
    rng = random.Random(22)
    alphabets = {"en": "etaoin shr", "ru": "оеаин тсрв", "el": "αοιετ σνηυ", "zh": "的一是不了人我在有他"}
    texts, langs = [], []
    for k in range(80):
        lang = rng.choice(list(alphabets))
        texts.append("".join(rng.choice(alphabets[lang]) for _ in range(rng.randrange(2, 120))) + rng.choice(["", " 12!", "É"]))
        langs.append(lang)
    found = {r.doc_id: r for r in language_id.identify(docs(spark, texts, langs=langs)).collect()}
    units = [p / np.linalg.norm(p) for p in map(plain_profile, texts)]
    names = sorted(alphabets)
    seen: set = set()
    sums = dict.fromkeys(names, 0)
    for i, (t, g) in enumerate(zip(texts, langs, strict=True)):
        if not found[i].held_out and (t, g) not in seen:
            seen.add((t, g))
            sums[g] = sums[g] + units[i]
    plain = np.stack([sums[g] / np.linalg.norm(sums[g]) for g in names])
    apart = plain - plain.mean(axis=0)
    apart /= np.linalg.norm(apart, axis=1, keepdims=True)
    near = np.stack([apart @ (u - plain.mean(axis=0)) for u in units])
    for i, r in found.items():
        best = int(near[i].argmax())
        assert r.lang_pred == names[best] and abs(r.score - min(1, max(0, plain[best] @ units[i]))) < 1e-4
    assert np.mean([r.lang_pred == langs[i] for i, r in found.items()]) > 0.95
    cosines = near.max(axis=1) / [np.linalg.norm(u - plain.mean(axis=0)) for u in units]
    kept = {r.doc_id for r in language_id.keep_identified(docs(spark, texts, langs=langs)).collect()}
    assert kept == {i for i, c in enumerate(cosines) if c > 3 / 32}


def test_language_samples_every_label(spark):
    texts = [f"the cat number {chr(97 + i % 26)}{chr(97 + i // 26)} sat" for i in range(400)] + ["der hund und die katze"] * 3
    labels, _ = language_id.learn(docs(spark, texts, langs=["en"] * 400 + ["de"] * 3), "text", "lang", train_docs=20)
    assert labels == ["de", "en"]


def test_language_keeps_labels_of_few_texts_in_many_rows(spark):
    few = [f"der hund und die katze {c}" for c in "abc"] * 1000
    many = [f"the cat number {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} sat" for i in range(3000)]
    hot = ["le petit chat dort"] * 3000
    labels, _ = language_id.learn(docs(spark, few + many + hot, langs=["de"] * 3000 + ["en"] * 3000 + ["fr"] * 3000), "text", "lang", train_docs=20)
    assert labels == ["de", "en", "fr"]


def test_language_of_many_labels(spark):
    word = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(3))
    texts = [f"{word(k)} {word(k * 7 % 2500)} {word(k * 11 % 2500)}" for k in range(2500)]
    labels, vectors = language_id.learn(docs(spark, texts, langs=[f"l{k}" for k in range(2500)]), "text", "lang")
    assert len(labels) == 2500 == len(vectors)


def test_language_sees_text_only(spark):
    texts = ["the cat and the dog " * 5] * 6 + ["der hund und die katze " * 5] * 6
    langs = ["en"] * 6 + ["de"] * 6
    a = language_id.identify(docs(spark, texts, langs=langs)).collect()
    held = {r.doc_id for r in a if r.held_out}
    other = ["zz" if i in held else x for i, x in enumerate(langs)]
    b = language_id.identify(docs(spark, texts, langs=other, sources=["q"] * 12)).collect()
    assert held and sorted(map(tuple, a)) == sorted(map(tuple, b))


@pytest.mark.parametrize("symbols", [1, 4096])
def test_suffix_array_and_prefixes(monkeypatch, symbols):
    monkeypatch.setattr(suffix_sorting, "SYMBOLS", symbols)
    rng = random.Random(5)
    for _ in range(300):
        b = bytes(rng.choice(rng.choice([b"a", b"ab", b"abcd"])) for _ in range(rng.randrange(50))) * rng.randrange(1, 3)
        text = np.r_[np.frombuffer(b, np.uint8), np.uint8(254)]
        t = np.r_[text[:-1].astype(np.int64) + 1, 0]
        sa = suffix_sorting.suffix_array(t)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        phi, plcp = suffix_sorting.permuted_lcp(text, sa)
        for i, j in zip(sa[1:].tolist(), sa[:-1].tolist(), strict=True):
            n = next(k for k in range(len(text)) if i + k >= len(text) or j + k >= len(text) or text[i + k] != text[j + k])
            assert plcp[i] == n and phi[i] == j


def test_repeats_equal_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    line = "Is onhe. "
    passage = sentence(rng, 90)
    texts = [sentence(rng, rng.randrange(0, 300), 10_000) for _ in range(40)]
    texts += [sentence(rng, 50) + " " + passage[k:] + " " + sentence(rng, 60) for k in range(0, 60, 7)]  # shared passages
    texts += [line * 100, line * 80 + "x", "a" * 900, "a" * 401, "é" * 500, passage + " " + passage, None, "", "short", texts[3], texts[3]]
    base = sentence(rng, 200)
    texts += [base[:k] + "#" + base[k:] for k in range(0, len(base), 29)]  # near copies
    want = suffix_dedup.brute_force(texts)
    for crowded in (64, 3, 1000):
        monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
        found = sorted(suffix_dedup.removal_digests(docs(spark, texts).repartition(5)).collect(), key=lambda r: r.doc_id)
        assert [tuple(r)[1:5] for r in found] == want
        for r, t, w in zip(found, texts, want, strict=True):
            assert r.text == t if not w[1] else hashlib.sha256(r.text.encode()).hexdigest() == w[3] or "é" in t
    assert suffix_dedup.removal_digests(docs(spark, [])).count() == 0
    null_ids = suffix_dedup.removal_digests(docs(spark, texts, ids=[None] * len(texts))).collect()
    assert sorted(tuple(r)[1:5] for r in null_ids) == sorted(want)


def test_crowded_passage_makes_no_large_shard(spark, monkeypatch):
    rng = random.Random(16)
    passage = sentence(rng, 100, 10_000)
    texts = [f"{sentence(rng, 40, 10**6)} {passage} {sentence(rng, 40, 10**6)}" for _ in range(60)]
    largest = []
    plain = PandasGroupedOpsMixin.applyInPandas

    def spied(self, *args, **kwargs):
        largest.append(self._df.groupBy("shard").count().agg(F.max("count")).first()[0] or 0)
        return plain(self, *args, **kwargs)

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", spied)
    monkeypatch.setattr(suffix_dedup, "CROWDED", 8)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 100)
    found = suffix_dedup.removal_digests(docs(spark, texts)).collect()
    assert [tuple(r)[1:5] for r in sorted(found, key=lambda r: r.doc_id)] == suffix_dedup.brute_force(texts)
    assert largest and max(largest) < 30


def test_repeats_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want = suffix_dedup.brute_force([r.text for r in rows])
    assert [tuple(r)[1:5] for r in QUERIES["op6_suffix_dedup"](spark, SF).orderBy("doc_id").collect()] == want


def test_drop_repeats_keeps_clean_text(spark):
    rng = random.Random(7)
    passage = sentence(rng, 120)
    texts = ["é" + passage + " tail one", "head two " + passage, passage, sentence(rng, 20), None, ""]
    got = {r.doc_id: r for r in suffix_dedup.drop_repeats(docs(spark, texts)).collect()}
    assert got[0].text == "é tail one" and got[0].n_chars == 10 and got[1].text == "head two "
    assert 2 not in got and got[3].text == texts[3] and got[4].text is None and got[5].text == ""


def brute_components(texts, words, percent):
    sets = [set(shingle_set(t, words).tolist()) for t in texts]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                if label[i] != label[j] and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    a, b = label[i], label[j]
                    label = [min(a, b) if x in (a, b) else x for x in label]
                    changed = True
    return [(len(s), x) for s, x in zip(sets, label, strict=True)]


def family(rng, n, length, edits):
    base = [f"v{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_similar_equals_brute_force(spark, monkeypatch, words, percent):
    rng = random.Random(8)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    monkeypatch.setattr(ngram_join, "SET_BLOCK", 8)
    texts = [None, "", " \n", "A b", "a B", "a b c", "A  B\tc", "x", "é É"] + [sentence(rng, rng.randrange(3, 60)) for _ in range(20)]
    texts += family(rng, 60, 120, 2) + family(rng, 20, 60, 3) + family(rng, 6, 1500, 30)
    want = brute_components(texts, words, percent)
    got = ngram_join.similar(docs(spark, texts), words=words, percent=percent).collect()
    assert [tuple(r)[1:] for r in sorted(got, key=lambda r: r.doc_id)] == want
    kept = ngram_join.keep_one_of_each(docs(spark, texts), words=words, percent=percent)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, (_, c) in enumerate(want) if c == i] and len(kept.columns) == 9


def test_parts_of_near_copies_are_bounded(spark, monkeypatch):
    limit, largest = 20_000, []
    plain, parts = PandasCogroupedOps.applyInPandas, ngram_join.partitions_for

    def spied(self, *args, **kwargs):
        sent = self._gd2._df
        if "shingles" in sent.columns:
            largest.append(sent.groupBy("at").agg(F.sum(F.octet_length("shingles")).alias("n")).agg(F.max("n")).first()[0] or 0)
        return plain(self, *args, **kwargs)

    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", spied)
    monkeypatch.setattr(ngram_join, "partitions_for", lambda spark, n, target: parts(spark, n, limit))
    monkeypatch.setattr(ngram_join, "PART_BYTES", limit, raising=False)
    monkeypatch.setattr(ngram_join, "SET_BYTES", limit // 4, raising=False)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    texts = family(random.Random(18), 80, 120, 2)
    got = ngram_join.similar(docs(spark, texts)).collect()
    assert [tuple(r)[1:] for r in sorted(got, key=lambda r: r.doc_id)] == brute_components(texts, 3, 90)
    assert largest and max(largest) < 1.5 * limit, largest


def test_similar_odd_tables(spark):
    assert ngram_join.similar(docs(spark, [])).count() == 0
    rows = ngram_join.similar(docs(spark, ["a b c d"] * 4, ids=[5, 5, None, 3])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == [("3", 2, "3"), ("5", 2, "3"), ("5", 2, "3"), ("None", 2, "None")]
    kept = ngram_join.keep_one_of_each(docs(spark, ["a b c d", "a b c d", "q", None], ids=[5, 5, None, 3])).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "5", "None"]
    kept = ngram_join.keep_one_of_each(docs(spark, ["a b c d e f", "q r s t u v", "q r s t u v", "", "", "q r s t u v"], ids=[5, 5, 5, 7, 7, 9])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(5, "a b c d e f"), (5, "q r s t u v"), (7, ""), (7, "")]


def test_similar_query_equals_sql(spark):
    assert_same(QUERIES["op10_ngram_join"](spark, SF), ORACLES["op10_ngram_join"])


def test_prefixes_are_of_one_order():
    """Sets of the required similarity share a token of their prefixes, whatever the counts, in small and large sets."""
    rng = np.random.default_rng(19)
    for percent in (90, 80):
        for n in (1, 2, 5, 11, 40, 300):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.int64)).view(np.uint64)
            ids, sent, need = ngram_join.counted_tokens(np.concatenate([a, a]), np.array([len(a), len(a)]), percent)
            assert sent[0] == sent[1] and (ids[: sent[0]] == ids[sent[0] :]).all()
            assert sent[0] >= need[0] == ngram_join.prefix_length(len(a), percent)
            every = np.sort(ngram_join.token_ids(a))
            assert (np.sort(ids[: sent[0]]) == every[: sent[0]]).all()  # the first by hash, so the pool comes before all others
            assert sent[0] == max(need[0], (every < ngram_join.pool_limit(percent)).sum())
            assert [len(np.frombuffer(p, np.uint32)) for p in ngram_join.further_prefixes(a, percent)] == [need[0]] * ngram_join.ORDERS


def test_sketches_never_overstate():
    rng = np.random.default_rng(20)
    x = np.unique(rng.integers(0, 2**63, 700, dtype=np.int64).view(np.uint64))
    sets = [x[:40], x[:400], x[20:420], x[100:700]]
    found = ngram_join._Sketches([ngram_join.sketch(s) for s in sets])
    for i in range(4):
        for j in range(4):
            assert found.far(np.array([i]), np.array([j]))[0] <= len(np.setxor1d(sets[i], sets[j]))


def test_family_below_the_threshold_sends_few_pairs(spark, monkeypatch):
    """Copies of a template that differ too much to link: nearly all pairs are left out before they leave a block."""
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    sent = []
    plain = ngram_join._verify
    monkeypatch.setattr(ngram_join, "_verify", lambda pairs, *rest: sent.append(pairs.count()) or plain(pairs, *rest))
    rng = random.Random(21)
    base = [f"v{k}" for k in range(300)]
    texts = []
    for i in range(60):
        w = list(base)
        for k in range(9):
            w[rng.randrange(300)] = f"e{i}_{k}"
        texts.append(" ".join(w))
    got = ngram_join.similar(docs(spark, texts), words=5, percent=80).collect()
    assert [tuple(r)[1:] for r in sorted(got, key=lambda r: r.doc_id)] == brute_components(texts, 5, 80)
    assert sum(sent) < 60 * 59 / 2 / 4, sent
