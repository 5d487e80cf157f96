import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from delspan.functions import blocks, colours, names
from delspan.operators import alignments, context, images, metrics, refine, regions, sampling, scoring, tensors, variants
from delspan.plans import jobs


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_size_classes_and_anchor_cut(spark):
    rows = frame(spark, [(str(n), "1", 5000, 5000 + n, "DEL", n, "") for n in (10, 199, 200, 699, 700, 701, 999, 1000)], "region_id string, chrom string, start long, end long, sv_type string, length long, size_class string")
    got = [r.c for r in rows.select(variants.size_class(F.col("length")).alias("c")).collect()]
    assert got == ["SMALL", "SMALL", "MEDIUM", "MEDIUM", "LARGE", "LARGE", "LARGE", "VERY_LARGE"]
    up = {r.region_id: r.end - r.start for r in variants.anchors(rows).where("kind = 'up'").collect()}
    assert up["700"] == 700 and up["701"] == 560
    both = variants.anchors(rows).collect()
    assert {(r.region_id, r.kind): r.start for r in both}[("10", "down")] == 5160


def test_tiles_partition_a_region(spark):
    rows = frame(spark, [("a", "del", "1", 3, 203), ("b", "del", "1", 0, 64), ("c", "up", "1", -30, 40), ("d", "up", "1", 9, 9)], "region_id string, kind string, chrom string, start long, end long")
    got = regions.tile(rows).orderBy("region_id", "start").collect()
    assert [(r.start, r.end) for r in got if r.region_id == "a"] == [(3, 53), (53, 103), (103, 153), (153, 203)]
    assert [(r.start, r.end) for r in got if r.region_id == "b"] == [(0, 50), (50, 64)]
    assert [(r.start, r.end) for r in got if r.region_id == "c"] == [(20, 40)]  # the window before 0 goes
    assert not [r for r in got if r.region_id == "d"]
    assert [r.start for r in regions.tile(rows, min_width=25).where("region_id = 'b'").collect()] == [0]


def test_overlap_join_equals_nested_loop(spark):
    rng = np.random.default_rng(1)
    reads = [(f"r{i}", str(rng.integers(1, 3)), int(s), int(s + rng.integers(1, 3000))) for i, s in enumerate(rng.integers(0, 9000, 200))]
    windows = [(f"w{i}", str(rng.integers(1, 3)), int(s), int(s + rng.integers(1, 2500))) for i, s in enumerate(rng.integers(0, 9000, 100))]
    got = regions.overlap_join(frame(spark, reads, "qname string, chrom string, ref_start long, ref_end long"), frame(spark, windows, "window_id string, chrom string, start long, end long")).select("qname", "window_id").collect()
    want = {(q, w) for q, c, a, b in reads for w, d, s, e in windows if c == d and a < e and b > s}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_overlap_join_of_any_width(spark):
    rng = np.random.default_rng(2)

    def some(n, prefix):
        starts = rng.integers(-2000, 1 << 29, n)
        return [(f"{prefix}{i}", str(rng.integers(1, 3)), int(s), int(s + 2 ** rng.uniform(0, 29))) for i, s in enumerate(starts)]

    a, b = some(150, "a") + [("x", "1", 0, 1 << 29), ("e", "1", 5, 5), ("n", None, 0, 9), ("d", "1", 1023, 1025), ("d", "1", 1023, 1025)], some(120, "b") + [("y", "1", 1024, 1025), ("z", "2", -5, 1)]
    left = frame(spark, a, "p string, chrom string, ref_start long, ref_end long")
    right = frame(spark, b, "q string, chrom string, start long, end long")
    got = sorted(map(tuple, regions.overlap_join(left, right).select("p", "q").collect()))
    assert got == sorted((p, q) for p, c, s, e in a for q, d, t, u in b if c == d and s < u and e > t and e > s)
    # each is one row where it stands, and at most one on each level where it asks
    assert regions._nested(left, "ref_start", "ref_end").count() == len(a) - 1
    assert regions._asking(regions._nested(left, "ref_start", "ref_end"), "ref_start", 0).count() <= (len(regions.LEVELS) + 1) * len(a)


def test_window_join_equals_nested_loop(spark):
    rng = np.random.default_rng(4)
    reads = [(f"r{i}", str(rng.integers(1, 3)), int(s), int(s + rng.integers(1, 900))) for i, s in enumerate(rng.integers(0, 3000, 200))]
    windows = [(f"w{i}", str(rng.integers(1, 3)), int(s), int(s + rng.integers(1, 51))) for i, s in enumerate(rng.integers(0, 3500, 150))]
    left = frame(spark, reads, "qname string, chrom string, ref_start long, ref_end long")
    got = regions.window_join(left, frame(spark, windows, "window_id string, chrom string, start long, end long"), bin_size=64)
    want = {(q, w) for q, c, a, b in reads for w, d, s, e in windows if c == d and a < e and b > s}
    rows = [tuple(r) for r in got.select("qname", "window_id").collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert got.groupBy("window_id").agg(F.countDistinct("bin").alias("n")).where("n > 1").count() == 0
    with pytest.raises(Exception, match="wider than 50"):
        regions.window_join(left, frame(spark, [("w", "1", 0, 51)], "window_id string, chrom string, start long, end long")).collect()


def test_stored_reads_are_joined_where_they_lie(spark, tmp_path):
    rng = np.random.default_rng(5)
    reads = frame(spark, [(f"r{i}", str(rng.integers(1, 3)), int(s), int(s + rng.integers(1, 900))) for i, s in enumerate(rng.integers(0, 9000, 500))], "qname string, chrom string, ref_start long, ref_end long")
    windows = frame(spark, [(f"w{i}", str(rng.integers(1, 3)), int(s), int(s + rng.integers(1, 51))) for i, s in enumerate(rng.integers(0, 9000, 300))], "window_id string, chrom string, start long, end long")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        regions.store_by_bin(reads, "some_reads", str(tmp_path / "stored"), 4)
        pairs = regions.stored_window_join(spark.table("some_reads"), windows)
        got = sorted(map(tuple, pairs.select("qname", "window_id").collect()))
        plan = pairs.groupBy("chrom", "bin", "window_id").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE IF EXISTS some_reads")
    assert got == sorted(map(tuple, regions.window_join(reads, windows).select("qname", "window_id").collect()))
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # the windows are shuffled, the reads aren't, nor what is grouped


def test_covariance_of_wide_vectors(spark):
    x = np.random.default_rng(9).normal(size=(300, 768)).astype(np.float32)
    rows = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "context_raw array<float>").repartition(6)
    got = context.covariance(rows).toPandas()
    assert len(got) == 768 * 769 // 2
    want = np.cov(x.T.astype(float), bias=True)
    assert np.allclose(got["cov"], want[got["i"], got["j"]], atol=1e-9)
    means = context.mean_vector(rows).toPandas()
    assert np.allclose(means["mean"], x.astype(float).mean(0)[means["i"]]) and len(means) == 768
    assert context.covariance(rows.where("context_raw is null")).count() == 0


@pytest.mark.parametrize("gap", [0, 7])
def test_merge_equals_a_plain_loop(spark, monkeypatch, gap):
    monkeypatch.setattr(regions, "MERGE_BIN", 40)
    rng = np.random.default_rng(5)
    rows = [(str(rng.integers(1, 4)), int(s), int(s + rng.integers(1, rng.choice([10, 200]))), float(round(rng.random(), 3))) for s in rng.integers(0, 6000, 120)]
    want: list[list] = []
    for c, s, e, p in sorted(rows):
        if want and want[-1][0] == c and s <= want[-1][2] + gap:
            want[-1][2] = max(want[-1][2], e)
            want[-1][3].append(p)
        else:
            want.append([c, s, e, [p]])
    got = regions.merge_adjacent(frame(spark, rows, "chrom string, start long, end long, prob double"), gap).orderBy("chrom", "start").collect()
    assert [(r.chrom, r.start, r.end, r.n, r.max_prob) for r in got] == [(c, s, e, len(p), max(p)) for c, s, e, p in want]
    assert [r.mean_prob for r in got] == pytest.approx([sum(p) / len(p) for *_, p in want])


def read(qname, flag, start, seq, qual, mapq=60, cigar=None):
    return (qname, flag, "1", start, mapq, cigar or f"{len(seq)}M", 0, seq, qual)


READS = "qname string, flag int, chrom string, ref_start long, mapq long, cigar string, tlen long, seq string, qual string"


def test_one_base_of_two_overlapping_mates(spark):
    reads = frame(spark, [read("m", 99, 10, "AAAAAA", "555555"), read("m", 147, 12, "CCCCCC", "66!666"), read("n", 0, 11, "GGGG", "5555"), read("low", 0, 10, "TTTTTT", "!!!!!!"), read("orphan", 1, 10, "TTTTTT", "555555"), read("copy", 1024, 10, "TTTTTT", "555555")], READS)
    window = frame(spark, [("w", "1", 10, 20), ("v", "1", 13, 14)], "window_id string, chrom string, start long, end long")
    rows = alignments.pileup(reads, window)
    column = lambda w, pos: [(r.base, r.row_idx) for r in rows.where((F.col("window_id") == w) & (F.col("pos") == pos)).orderBy("row_idx").collect()]
    assert column("w", 10) == [("A", 0)] and column("w", 11) == [("A", 0), ("G", 1)]
    assert column("w", 12) == [("G", 0), ("C", 1)]  # the second mate's base is better
    assert column("w", 14) == [("A", 0), ("G", 1)]  # here it is worse
    assert column("w", 13) == column("v", 13) == [("G", 0), ("C", 1)] and column("w", 17) == [("C", 0)] and rows.where("window_id = 'v'").count() == 2
    both = alignments.pileup(reads, window, alignments.PileupOptions(one_of_overlapping_mates=False, ignore_orphans=False, exclude_flags=0, min_base_quality=0))
    assert both.where("window_id = 'w' and pos = 12").count() == 6
    assert alignments.pileup(reads, window, alignments.PileupOptions(max_depth=1)).where("window_id = 'w' and pos = 12").count() == 1


def test_qualities_of_mates(spark):
    """By quality: 7 and 8 agree and pass 13 together; 14 against 3 keeps 11; 20 against 20 keeps the first's 16; unpaired reads of one name are no mates."""
    q = lambda *x: "".join(chr(33 + k) for k in x)
    reads = [read("m", 99, 10, "ACGTA", q(7, 14, 20, 30, 12)), read("m", 147, 10, "AGTTC", q(8, 3, 20, 30, 90)), read("u", 0, 10, "AAAAA", q(12, 14, 12, 12, 12)), read("u", 0, 10, "AAAAA", q(12, 14, 12, 12, 12))]
    window = frame(spark, [("w", "1", 10, 20)], "window_id string, chrom string, start long, end long")
    got = alignments.pileup(frame(spark, reads, READS), window).groupBy("pos").agg(F.sort_array(F.collect_list("base")).alias("b")).collect()
    assert {r.pos: r.b for r in got} == {10: ["A"], 11: ["A", "A"], 12: ["G"], 13: ["T"], 14: ["C"]}
    three = [read("m", 99, 10, "A", q(9)), read("m", 147, 10, "A", q(9)), read("m", 2195, 10, "A", q(40))]
    assert alignments.pileup(frame(spark, three, READS), window).count() == 2  # the third has no partner


def test_cells_of_both_colourings(spark, tmp_path):
    reads = frame(spark, [read("a", 3, 10, "ACGT", "5555"), read("b", 3, 11, "CGTA", "5555", mapq=10, cigar="2S4M")], READS)
    window = frame(spark, [("w", "1", 10, 20)], "window_id string, chrom string, start long, end long")
    reads = reads.withColumn("seq", F.when(F.col("qname") == "b", "GGCGTA").otherwise(F.col("seq"))).withColumn("qual", F.when(F.col("qname") == "b", "555555").otherwise(F.col("qual")))
    clips = alignments.clips(reads)
    rows = alignments.pileup(reads, window, clips=clips)
    plain = {(r.pos, r.row_idx): (r.x0, r.y0, r.x1, r.y1, r.r, r.g, r.b) for r in images.cells(rows).collect()}
    assert plain[10, 0] == (5, 5, 10, 10, 255, 0, 0)  # A, no flags, no clip
    assert plain[11, 0] == (10, 5, 15, 10, 1, 1, 255)  # C; one read is clipped here
    assert plain[11, 1] == (10, 10, 15, 15, 71, 71, 255)  # low mapping quality: 50 + 10 * 2, and the clip
    joined = {(r.pos, r.row_idx): (r.x0, r.y0, r.x1, r.y1, r.r, r.g, r.b) for r in images.cells(rows.drop("clip"), clips).collect()}
    assert joined == plain
    (tmp_path / "p.json").write_text('{"NNNACG": [1, 2, 3],\n "NGGCGT": [40, 50, 60]}')
    palette = images.read_palette(spark, str(tmp_path / "p.json"))
    found = {(r.pos, r.row_idx): (r.r, r.g, r.b) for r in images.cells(rows, palette=palette).collect()}
    assert found[10, 0] == (1, 2, 3)  # the palette's colour as it is
    assert found[11, 1] == (40, 50, 60)  # neither flags nor clips change it
    assert {v for k, v in found.items() if k not in ((10, 0), (11, 1))} == {(0, 0, 0)}  # black where the palette has none


def test_means_without_cells(spark):
    rng = np.random.default_rng(9)
    reads = []
    for i in range(80):
        cigar = rng.choice(["30M", "5S20M", "10M3D12M2S", "8M2I9M5N6M", "4H1M", "1M", "12M1P4M3S", "6I"])
        n = sum(int(k) for k, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar) if op in "MIS=X")
        flag = int(rng.choice([0, 3, 1, 16, 99, 1024]))
        reads.append((f"r{i}", flag, "1", int(rng.integers(0, 120)), int(rng.integers(0, 70)), str(cigar), int(rng.integers(-200, 200)), "".join(rng.choice(list("ACGTNacg"), n)), "".join(rng.choice(list("!+5?JZ"), n))))
    reads = frame(spark, reads, READS)
    windows = frame(spark, [(f"w{s}", "1", s, s + 50) for s in range(0, 200, 20)] + [("e", "1", 900, 950), ("z", "2", 0, 50)], "window_id string, chrom string, start long, end long")
    for most in (100, 3):
        want = {r.window_id: r for r in tensors.channel_means(tensors.tensor_cells(reads, windows, most), most).collect()}
        got = {r.window_id: r for r in tensors.window_means(reads, windows, most).collect()}
        assert got.keys() == want.keys() and len(want) > 5
        for w, r in want.items():
            assert [got[w][c] for c in tensors.CHANNELS] == pytest.approx([r[c] for c in tensors.CHANNELS]), w


def test_unknown_size_classes(spark):
    rows = frame(spark, [("a", "1", 0, 10, 10, "SMALL")], "region_id string, chrom string, start long, end long, length long, size_class string")
    with pytest.raises(ValueError, match="TINY"):
        variants.selected(rows, ("SMALL", "TINY"))
    with pytest.warns(UserWarning, match="TINY"):
        assert variants.selected(rows, ("SMALL", "TINY"), lenient=True).count() == 1


def test_resampling_draws_exactly(spark):
    rows = frame(spark, [(f"w{i}", int(i % 50 == 0)) for i in range(1000)], "window_id string, label int")
    got = sampling.resampled(rows, 3000)
    by = {r.label: r["count"] for r in got.groupBy("label").count().collect()}
    assert sum(by.values()) == 3000 and abs(by[1] - 1500) < 200
    again = sampling.resampled(rows.repartition(5), 3000)
    assert again.exceptAll(got).count() == 0 and got.exceptAll(again).count() == 0
    most = got.where("label = 1").groupBy("window_id").count().agg(F.min("count"), F.max("count"), F.count("*")).first()
    assert most[2] == 20 and most[0] > 30 and most[1] < 130
    assert sampling.resampled(rows.where("label = 0"), 10).count() == 10 and sampling.resampled(rows.limit(0), 10).count() == 0


@pytest.mark.parametrize("slices", [2, 5, 64])
def test_curve_as_plotted(spark, monkeypatch, slices):
    """It begins at (0, 0); points on a straight line between their neighbours are left out, across slices too."""
    monkeypatch.setattr(metrics, "SLICES", slices)
    rng = np.random.default_rng(slices)
    rows = [(e, int(y), int(p) / 200) for e, y, p in zip(rng.integers(0, 2, 300), rng.integers(0, 2, 300), rng.integers(0, 200, 300), strict=True)]
    rows = [(int(e), y, p) for e, y, p in rows] + [(2, 1, 0.5)]
    got = metrics.roc_curve(frame(spark, rows, "epoch int, label int, prob double"), ["epoch"]).collect()
    want = []
    for e in (0, 1, 2):
        own = [(y, p) for x, y, p in rows if x == e]
        marks = sorted({p for _, p in own}, reverse=True)
        tps = np.array([sum(y for y, p in own if p >= m) for m in marks])
        fps = np.array([sum(1 - y for y, p in own if p >= m) for m in marks])
        keep = np.r_[True, (np.diff(fps, 2) != 0) | (np.diff(tps, 2) != 0), [True] * (len(marks) > 1)]
        want += [(e, None, 0, 0)] + [(e, marks[k], fps[k] / max(fps[-1], 1), tps[k] / max(tps[-1], 1)) for k in np.flatnonzero(keep)]
    key = lambda r: (r[0], -2 if r[1] is None else -r[1])
    assert [pytest.approx(tuple(r), nan_ok=True) == w for r, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True)].count(False) == 0


def test_curve_of_scores_near_zero(spark):
    rng = np.random.default_rng(6)
    rows = [(int(y), float(p)) for y, p in zip(rng.integers(0, 2, 400), rng.random(400) / 1000, strict=True)]
    whole = metrics.roc_curve(frame(spark, rows, "label int, prob double"), drop_intermediate=False)
    got = whole.where("prob is not null").collect()
    pos, neg = sum(y for y, _ in rows), sum(1 - y for y, _ in rows)
    assert len(got) == len({p for _, p in rows})
    for r in got[::17]:
        assert r.tpr == pytest.approx(sum(y for y, p in rows if p >= r.prob) / pos) and r.fpr == pytest.approx(sum(1 - y for y, p in rows if p >= r.prob) / neg)


def test_kmer_frequencies_by_hand():
    got = context.kmer_frequencies()("ACGNACGTé")
    assert got.sum() == pytest.approx(1) and got[6] == pytest.approx(2 / 3) and got[27] == pytest.approx(1 / 3)  # ACG twice, CGT once
    assert context.kmer_frequencies()("AC").sum() == 0


def test_candidate_means_are_compared_with_floored_four_fifths(spark):
    """Scaled means 3, 4 and 90: 3 is below 3.2 but not below its floor, so there is no candidate; 2 is."""
    schema = "region_id string, cluster int, mean double, least double, left long, right long"
    rows = [(name, k, m, m, 10 * k, 10 * k) for name, low in (("a", 3.0), ("b", 2.0)) for k, m in enumerate((90.0, low, 4.0))]
    assert [r.region_id for r in refine.detected(frame(spark, rows, schema)).collect()] == ["b"]


def test_of_two_greatest_clusters_the_later_is_in_the_middle(spark):
    schema = "region_id string, cluster int, mean long, least long, left long, right long"
    rows = [("a", 0, 10, 7, 100, 200), ("a", 1, 2, 1, 130, 150), ("a", 2, 10, 9, 110, 190)]
    assert [tuple(r) for r in refine.decide(frame(spark, rows, schema)).collect()] == [("a", 130, 150, 9)]


def test_merge_across_bins(spark):
    big = regions.MERGE_BIN
    rows = frame(spark, [("1", 0, 50, 0.6), ("1", 50, 100, 0.8), ("1", 150, 200, 0.9), ("1", big - 50, big, 0.7), ("1", big, big + 50, 0.9), ("2", 0, 50, 1.0)], "chrom string, start long, end long, prob double")
    got = {(r.chrom, r.start): (r.end, round(r.mean_prob, 6), r.max_prob, r.n) for r in regions.merge_adjacent(rows).collect()}
    assert got == {("1", 0): (100, 0.7, 0.8, 2), ("1", 150): (200, 0.9, 0.9, 1), ("1", big - 50): (big + 50, 0.8, 0.9, 2), ("2", 0): (50, 1.0, 1.0, 1)}
    assert regions.merge_adjacent(rows, gap=50).where("chrom = '1' and start = 0").first().end == 200


@pytest.mark.parametrize(
    "base, paired, proper, mapq, cigar, clip, rgb",
    [("A", True, True, 60, 0, 0, (255, 0, 0)), ("G", True, True, 60, 0, 3, (3, 3, 3)), ("T", False, False, 10, 0, 0, (190, 255, 190)), ("C", True, False, 20, 4, 1, (101, 101, 255)), ("N", False, False, 0, 4, 0, (200, 200, 200))],
)
def test_colours(spark, base, paired, proper, mapq, cigar, clip, rgb):
    row = frame(spark, [(base, paired, proper, mapq, cigar, clip)], "base string, paired boolean, proper boolean, mapq int, cigar int, clip int")
    index = colours.flag_index(F.col("paired"), F.col("proper"), F.col("mapq"), F.col("cigar"))
    assert tuple(row.select(*(colours.shaded(colours.base_channel(F.col("base"), c), index, F.col("clip")) for c in "rgb")).first()) == rgb


def test_rendered_rectangles_overlap_their_borders(spark):
    cells = frame(spark, [("w", 0, 0, 5, 5, 10, 10, 1, 1, 1), ("w", 1, 0, 10, 5, 15, 10, 2, 2, 2), ("w", 0, 99, 5, 500, 10, 505, 9, 9, 9)], "window_id string, pos long, row_idx int, x0 long, y0 long, x1 long, y1 long, r int, g int, b int")
    image = np.frombuffer(images.render(cells).first().pixels, np.uint8).reshape(256, 256, 3)
    assert image[5, 5, 0] == 1 and image[5, 10, 0] == 2 and image[10, 15, 0] == 2 and image[4, 5, 0] == 0 and image[11, 5, 0] == 0


def test_pixels_normalised(spark):
    got = frame(spark, [([0.0, 255.0],)], "v array<double>").select(colours.normalised(F.col("v"), 0.5, 0.25).alias("x")).first().x
    assert got == [-2.0, 2.0]


def test_names(spark):
    rows = frame(spark, [("del_1_5_55",), ("non_del_up_X_-5_45",), ("NA_1_non_del_2_0_50",), ("S_del_1_0_9",), ("nothing",)], "n string")
    got = [r.p and tuple(r.p) for r in rows.select(names.parsed(F.col("n")).alias("p")).collect()]
    assert got == [(None, "del", "1", 5, 55), (None, "non_del_up", "X", -5, 45), ("NA_1", "non_del", "2", 0, 50), ("S", "del", "1", 0, 9), None]


def test_metrics_by_hand(spark):
    rows = scoring.with_prediction(frame(spark, [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "label int, prob double"))
    assert sorted(tuple(r) for r in metrics.confusion(rows).collect()) == [(0, 0, 2), (0, 1, 0), (1, 0, 1), (1, 1, 1)]
    report = {r.label: (r.precision, r.recall, r.f1) for r in metrics.class_report(rows).collect()}
    assert report[0] == pytest.approx((2 / 3, 1, 0.8)) and report[1] == pytest.approx((1, 0.5, 2 / 3))
    s = metrics.summary(rows).first()
    assert (s.macro_f1, s.weighted_f1, s.balanced_accuracy, s.accuracy) == pytest.approx((11 / 15, 11 / 15, 0.75, 75))
    r = metrics.ranking_scores(rows).first()
    assert (r.roc_auc, r.average_precision) == pytest.approx((0.75, 5 / 6))
    assert [w.weight for w in sampling.class_weights(rows).collect()] == [1.0, 1.0]


def test_auc_equals_pair_counting(spark):
    rng = np.random.default_rng(2)
    rows = [(int(y), round(float(p), 2)) for y, p in zip(rng.integers(0, 2, 300), rng.random(300), strict=True)]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])
    assert metrics.ranking_scores(frame(spark, rows, "label int, prob double")).first().roc_auc == pytest.approx(want)


def test_empty_metrics(spark):
    rows = scoring.with_prediction(frame(spark, [], "label int, prob double"))
    assert metrics.summary(rows).first().weighted_f1 == 0.0
    assert [r.n for r in metrics.confusion(rows).collect()] == [0, 0, 0, 0]
    assert [r.weight for r in sampling.class_weights(rows).collect()] == [0.0, 0.0]


def test_best_epoch_is_the_first_maximum(spark):
    history = frame(spark, [(1, 0.5), (2, 0.7), (3, 0.7), (4, 0.6)], "epoch int, weighted_f1 double")
    assert metrics.best_epoch(history).first().epoch == 2
    assert [r.epoch for r in metrics.saved_epochs(history).orderBy("epoch").collect()] == [1, 2]
    assert metrics.best_epoch(frame(spark, [(1, 0.0)], "epoch int, weighted_f1 double")).count() == 0


def test_calls(spark):
    rows = frame(spark, [("1", 0, 50, 0.9), ("1", 50, 100, 0.5), ("1", 100, 150, 0.7), ("1", 150, 200, 0.71), ("1", 200, 250, None)], "chrom string, start long, end long, prob double")
    got = [(r.start, r.filter_status) for r in scoring.calls(rows).orderBy("start").collect()]
    assert got == [(100, "LowQual"), (150, "PASS")]  # strict thresholds; a start of 0 is dropped
    assert scoring.calls(rows, drop_zero_start=False).count() == 3
    merged = jobs.call_deletions(rows, merge_gap=0).orderBy("start").collect()
    assert [(r.start, r.end) for r in merged] == [(0, 50), (100, 200)]


def test_softmax_tie_is_class_0(spark):
    prob, pred = scoring.softmax(F.lit(1.5), F.lit(1.5))
    assert tuple(spark.range(1).select(prob, pred).first()) == (0.5, 0)


def test_failing_rows_score_zero(spark):
    def load():
        def model(x):
            if (x < 0).any():
                raise KeyError("bad row")
            return x.sum(axis=1)

        return model

    rows = frame(spark, [(1, [0.75]), (2, [-1.0]), (3, None)], "i int, f array<double>")
    assert [(r.prob, r.pred) for r in scoring.score(rows, "f", load).orderBy("i").collect()] == [(0.75, 1), (0.0, 0), (0.0, 0)]


def test_quota_and_balance(spark):
    rows = [(f"r{i}", k, int(k == "del"), "1", s, s + 50, f"r{i}_{k}_{s}") for i in range(40) for k in ("del", "up") for s in (0, 50)] + [("z", "del", 1, "2", 0, 50, "z")]
    windows = frame(spark, rows, "region_id string, kind string, label int, chrom string, start long, end long, window_id string")
    got = sampling.quota(windows, {"del": 5, "up": 3}).groupBy("chrom", "kind").count().collect()
    assert {(r.chrom, r.kind): r["count"] for r in got} == {("1", "del"): 5, ("1", "up"): 3, ("2", "del"): 1}
    kept = sampling.quota(windows, {"del": 4}).where("chrom = '1'").groupBy("region_id").count().collect()
    assert [r["count"] for r in kept] == [2, 2]  # whole regions in turn
    assert {r.label: r["count"] for r in sampling.balanced(windows).groupBy("label").count().collect()} == {0: 80, 1: 80}
    again = sampling.balanced(windows.repartition(7)).select("window_id")
    assert again.exceptAll(sampling.balanced(windows).select("window_id")).count() == 0
    assert sampling.balanced(windows.where("label = 1")).count() == 0


def test_kmeans_is_a_fixed_point():
    x = np.c_[np.arange(90), np.repeat([10, 0, 10], 30) * 100]
    labels = refine._labels(x, np.array([90]), [], 0)
    assert labels[45] not in (labels[0], labels[-1])
    centres = np.stack([x[labels == i].mean(axis=0) for i in range(3)])
    assert (np.argmin(((x[:, None] - centres) ** 2).sum(2), axis=1) == labels).all()
    assert set(refine._labels(np.zeros((9, 2), int), np.array([9]), [], 0)) == {0}  # ties go to the lowest label
    assert set(refine._labels(np.zeros((9, 2), int), np.array([9]), ["r"], 10)) == {0}


def test_sliding_medians_equal_numpy():
    rng = np.random.default_rng(1)
    sizes = np.array([0, 5, 61, 62, 700, 1300, 60, 9])
    for values in (rng.poisson(5, sizes.sum()), rng.integers(0, 5000, sizes.sum()), np.zeros(sizes.sum(), int)):
        for frame_, rows in ((61, 100), (3, 7), (1, 512)):
            ends = np.cumsum(sizes)
            want = [np.median(values[b + k : b + k + frame_]) for b, n in zip(ends - sizes, sizes, strict=True) for k in range(n - frame_ + 1)]
            assert blocks.sliding_medians(values, sizes, frame_, rows).tolist() == want


def test_a_long_range_is_clustered(spark):
    """A megabase as one range."""
    rows = spark.range(1).select(F.lit("s").alias("region_id"), F.lit("1").alias("chrom"), F.lit(0).cast("long").alias("first"), F.transform(F.sequence(F.lit(0), F.lit(999_999)), lambda p: F.when((p >= 400_000) & (p < 600_000), 0).otherwise(30 + p % 7).cast("long")).alias("depth"))
    stats = {r.cluster: r for r in refine.clustered(rows.withColumn("clip", F.transform("depth", lambda d: d * 0)), right_extra=1, restarts=2).collect()}
    assert len(stats) == 3 and min(r.left for r in stats.values()) == 30 and max(r.right for r in stats.values()) == 999_968


def test_operations_of_long_reads():
    of, op, length = blocks.operations(pa.array(["1M2I" * 20_000, None, "", "*", "M5", "12x3M", "99999999999M"]))
    assert (np.bincount(of, minlength=7) == [40_000, 0, 0, 0, 0, 1, 1]).all()
    assert length[-2:].tolist() == [3, 99_999_999_999] and bytes(op[-2:]) == b"MM"


def test_a_read_without_reference_end_keeps_its_left_clip(spark):
    reads = frame(spark, [("a", 0, "1", 100, 9, "20S", 0, "A" * 20, "I" * 20), ("b", 0, "1", 100, 9, "5S15M", 0, "A" * 20, "I" * 20), ("c", 0, "1", 95, 9, "3M3H", 0, "AAA", "III"), ("d", 0, "1", 97, 9, None, 0, "A", "I")], "qname string, flag int, chrom string, ref_start long, mapq int, cigar string, tlen int, seq string, qual string")
    assert {r.pos: r.clip for r in alignments.clips(reads).collect()} == {100: 2, 97: 1}


def test_depth_of_deep_and_odd_reads(spark, monkeypatch):
    monkeypatch.setattr(alignments, "DENSE", 5)
    rng = np.random.default_rng(8)
    cigars = ["10M", "4M700D6M", "2S8M", "3M2I5M", "*", None, "10M5H", "5=5X", "4M30N6M", "10S"]
    reads = [(f"r{i}", int(rng.choice([0, 0, 0, 4, 1024])), str(rng.choice(["1", "X"])), int(rng.choice([100, 1020, 1024, 5000])), 9, cigars[i % 10], 0, "".join(rng.choice(list("ACGTNacgt"), 10)), "".join(rng.choice(list("#/0I"), 10))) for i in range(300)]
    reads += [("s", 0, "1", 50, 9, "10M", 0, "ACG", "IIIIIIIIII"), ("t", 0, None, 50, 9, "3M", 0, "ACG", "III"), ("u", 0, "1", 50, 9, "3M", 0, None, "III"), ("v", 0, "1", None, 9, "3M", 0, "ACG", "III")]
    schema = "qname string, flag int, chrom string, ref_start long, mapq int, cigar string, tlen int, seq string, qual string"
    want = {}
    for _, flag, chrom, start, _, cigar, _, seq, qual in reads:
        if flag or start is None or seq is None:
            continue
        q, r = 0, start
        for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar or ""):
            for k in range(int(n)):
                if op in "M=X" and q + k < len(seq) and q + k < len(qual) and seq[q + k].upper() in "ACGT" and ord(qual[q + k]) >= 48:
                    own = want.setdefault((chrom, r + k), [0, 0, 0, 0])
                    own["ACGT".index(seq[q + k].upper())] += 1
            q += int(n) * (op in "MIS=X")
            r += int(n) * (op in "MDN=X")
    rows = frame(spark, reads, schema)
    assert {(x.chrom, x.pos): [x.a, x.c, x.g, x.t] for x in alignments.depth(rows).collect()} == want
    arrays = {(x.chrom, x.bin): x.depth for x in alignments.depth_arrays(rows, bins=frame(spark, [("1", 0), ("X", 1), ("X", 1), ("1", 77)], "chrom string, bin long")).collect()}
    assert set(arrays) == {("1", 0), ("X", 1)} and all(len(x) == 1024 for x in arrays.values())
    assert all(n == sum(want.get((c, b * 1024 + k), [0])) for (c, b), x in arrays.items() for k, n in enumerate(x))
    assert alignments.depth(rows.where("false")).count() == 0


def test_refinement_finds_a_hole(spark):
    depth = frame(spark, [("1", p, 30 + p * 7 % 11) for p in range(1000, 3000) if not 1800 <= p < 2200], "chrom string, pos long, depth long")
    clips = frame(spark, [("1", 1799, 4), ("1", 2200, 5)], "chrom string, pos long, clip long")
    region = frame(spark, [("a", "1", 1700, 2300, "DEL", 600, "MEDIUM"), ("low", "1", 100, 300, "DEL", 200, "MEDIUM")], "region_id string, chrom string, start long, end long, sv_type string, length long, size_class string")
    got = {r.region_id: (r.start, r.end, r.refined) for r in refine.refined(region, depth, clips).collect()}
    assert got["low"] == (100, 300, False)  # padding would begin before 0
    start, end, done = got["a"]
    assert done and 1780 <= start < 1800 and 2200 <= end < 2220
    scan = frame(spark, [("s", "1", 1500, 2500), ("t", "1", 1000, 1050)], "region_id string, chrom string, start long, end long")
    found = {r.region_id: (r.left, r.right) for r in refine.candidates(scan, depth, clips).collect()}
    assert set(found) == {"s"} and 1780 <= found["s"][0] < 1800 and 2200 <= found["s"][1] < 2220


def test_context(spark):
    contigs = frame(spark, [("1", 0, "ACGTN"), ("1", 5, "acgta"), ("2", 0, "GGCC")], "chrom string, chunk_start long, seq string")
    windows = frame(spark, [("a", "1", 0, 2), ("b", "1", 6, 10), ("c", "2", 0, 4), ("d", "9", 0, 4)], "window_id string, chrom string, start long, end long")
    got = {r.window_id: r.seq for r in context.sequences(windows, contigs, span=8).collect()}
    assert got["a"] == "ACGTN" and got["c"] == "GGCC" and "d" not in got
    assert got["b"] == "NACGTA" and context.rechunk(contigs, 10).count() == 2
    vectors = {r.window_id: r.context_raw for r in context.embeddings(context.sequences(windows, contigs, span=40), context.kmer_frequencies, 64).collect()}
    assert sum(vectors["c"]) == 0.0 and abs(sum(vectors["a"]) - 1) < 1e-5


def test_pca_equals_numpy(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6)) * [5, 3, 2, 1, 0.5, 0.1] + 7
    rows = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "i int, context_raw array<float>")
    model = context.fit_pca(rows, 2)
    model.write().overwrite().save(str(tmp_path / "pca"))
    got = np.array([r.context for r in context.apply_pca(rows, PipelineModel.load(str(tmp_path / "pca"))).orderBy("i").collect()])
    values, vectors = np.linalg.eigh(np.cov(x.T))
    v = vectors[:, ::-1][:, :2]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), range(2)])
    assert np.allclose(got, (x - x.mean(axis=0)) @ v, atol=1e-3)
    assert np.allclose(context.explained(model), values[::-1][:2] / values.sum(), atol=1e-3)


def test_context_channels(spark):
    dense = frame(spark, [("a", [1, 2, 2], [1.0] * 4), ("b", [1, 2, 2], [2.0] * 4)], "window_id string, shape array<int>, tensor array<float>")
    contexts = frame(spark, [("a", [0.5, 0.25])], "window_id string, context array<float>")
    got = {r.window_id: (r.shape, r.tensor) for r in tensors.with_context_channels(dense, contexts).collect()}
    assert got["a"] == ([3, 2, 2], [1.0] * 4 + [0.5] * 4 + [0.25] * 4) and got["b"] == ([1, 2, 2], [2.0] * 4)


def test_split_uses_bare_names(spark):
    rows = frame(spark, [("1",), ("chr1",), ("12",), ("X",)], "chrom string")
    assert sorted((r.chrom, r.split) for r in sampling.with_split(rows).collect()) == [("1", "train"), ("12", "validation")]
