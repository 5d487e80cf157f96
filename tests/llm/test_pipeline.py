"""The pipeline, stage by stage, against brute force over each stage's own input."""

import random
import zlib

import numpy as np

import corpus_pipeline
from delspan.llm import mixing, sentencepiece_bpe, suffix_dedup
from tests.llm.test_text_operators import brute_components, family, plain_profile, sentence

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def resembling(texts):
    """The rows whose profile is nearer to the only language's prototype than chance, letter by letter."""
    units = {i: p / np.linalg.norm(p) for i, t in enumerate(texts) if any(c.isalpha() for c in t or "") for p in [plain_profile(t)]}
    seen = {texts[i]: u for i, u in units.items() if zlib.crc32(str(i).encode()) % 5}
    prototype = sum(seen.values()) / np.linalg.norm(sum(seen.values()))
    return [i for i, u in units.items() if u @ prototype > 3 / 32]


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows, extra columns with the operators' own names, an empty table."""
    rng = random.Random(12)
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, row string, cls int, component_id string, spans int, tk string, key string"
    texts = [sentence(rng, 60, 5000) for _ in range(12)]
    twice = sentence(rng, 120, 5000)
    rows = [(i, t, "en" if i % 3 else None, None if i % 2 else "a") for i, t in enumerate(texts)]
    rows += [(None, texts[0], "en", "a"), (None, None, None, None), (20, None, "en", "a"), (21, "", "en", None), (22, "1 2", "en", "a"), (30, twice, "en", "b"), (30, twice, "en", "b"), (31, twice, None, "b"), (40, sentence(rng, 40, 900), "en", "b"), (40, sentence(rng, 40, 900), "en", "b")]
    rows = [(*r, None if r[1] is None else len(r[1]), "x", "y", 1, "z", 2, "t", "k") for r in rows]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        steps = []
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            path = str(tmp_path / f"{len(given)}-{k}{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if k < 4:
                assert docs.dtypes == spark.createDataFrame([], schema).dtypes
            steps.append(docs.collect())
        if not given:
            assert steps == [[]] * 5
            continue
        assert sorted((str(r.doc_id), r.text) for r in steps[0]) == sorted((str(r[0]), r[1]) for r in rows if any(c.isalpha() for c in r[1] or ""))
        assert sorted(str(r.doc_id) for r in steps[1]) == sorted([*map(str, range(12)), "None", "30", "40", "40"])
        assert sorted(r.text for r in steps[2]) == sorted(r.text for r in steps[1])  # no passage is long enough
        assert {str(r.doc_id) for r in steps[4]} <= {str(r.doc_id) for r in steps[2]}
        assert all(set(r.asDict()) == {"doc_id", "ids", "decoded"} for r in steps[4])


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    passage = sentence(rng, 110)
    texts = [sentence(rng, rng.randrange(5, 120), 5000) for _ in range(30)] + family(rng, 6, 80, 1) + [sentence(rng, 40) + " " + passage, passage + " " + sentence(rng, 50), "12 34", "", None]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "ngram_join", "suffix_dedup", "mixing", "sentencepiece"]
    steps, now = [], docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"{k}{name}"))
        now = spark.read.parquet(str(tmp_path / f"{k}{name}"))
        steps.append(now.collect())
        if k < 4:
            assert now.columns == COLUMNS
    identified, single, stripped, mix, encoded = steps
    assert sorted(r.doc_id for r in identified) == resembling(texts)
    rows = sorted(identified, key=lambda r: r.doc_id)
    groups = brute_components([r.text for r in rows], 5, 80)
    assert sorted(r.doc_id for r in single) == [rows[i].doc_id for i, (_, c) in enumerate(groups) if c == i]
    rows = sorted(single, key=lambda r: r.doc_id)
    want = suffix_dedup.brute_force([r.text for r in rows])
    kept = {r.doc_id: r.text for r in stripped}
    assert any(w[1] for w in want)
    for r, (n, removed, _, _) in zip(rows, want, strict=True):
        assert (r.doc_id in kept) == (removed < n or n == 0) and (removed or kept[r.doc_id] == r.text)
    expected = {r.doc_id: r for r in mixing.taken_words(spark.createDataFrame(stripped, docs.schema)).collect()}
    times: dict = {}
    for r in mix:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert all(times.get(i, 0) * e["size"] == e.taken for i, e in expected.items())
    model = sentencepiece_bpe.load(sentencepiece_bpe.default_model())
    assert sorted((r.doc_id, tuple(r.ids)) for r in encoded) == sorted((r.doc_id, tuple(model.encode(r.text))) for r in mix)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, tuple(r.ids), r.decoded) for r in whole) == sorted((r.doc_id, tuple(r.ids), r.decoded) for r in encoded)
