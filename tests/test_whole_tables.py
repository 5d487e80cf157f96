"""Queries that SQL can't express, over whole tables against plain loops and NumPy."""

from fractions import Fraction

import numpy as np
import pytest

from delspan.operators import alignments, context, refine, sampling, scoring, variants
from delspan.plans import queries as q
from delspan.sources import fixtures
from tests.compare import SF


@pytest.fixture(scope="module")
def covered(spark):
    reads = fixtures.table(spark, SF, "reads_holed")
    depth = {(r.chrom, r.pos): r.depth for r in alignments.depth(reads).collect()}
    clips = {(r.chrom, r.pos): r.clip for r in alignments.clips(reads).collect()}
    return depth, clips


def lloyd(points, rows, rounds=300):
    """Labels of k-means from the rows given; a cluster without points goes to zero."""
    centres, labels = points[rows], None
    for _ in range(rounds):
        far = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2)
        new = far.argmin(axis=1)
        if labels is not None and (new == labels).all():
            break
        labels = new
        centres = np.stack([points[labels == k].mean(axis=0) if (labels == k).any() else np.zeros(3) for k in range(len(rows))])
    return labels


def best_of(points, name, restarts):
    """Labels of the best of seeded starts: a row at random, then others with a chance as their squared distance."""
    best = None
    for numbers in refine.draws(name, restarts, 3).tolist():
        rows = [numbers[0] % len(points)]
        for draw in numbers[1:]:
            far = [int(min(((p - points[r]) ** 2).sum() for r in rows)) for p in points]
            k, left = 0, draw % max(1, sum(far))
            while sum(far) and left >= far[k]:
                left -= far[k]
                k += 1
            rows.append(k if sum(far) else draw % len(points))
        labels = lloyd(points, rows)
        own = [[tuple(map(Fraction, p)) for p in points[labels == k]] for k in range(3)]
        scatter = sum(sum(x * x for x in c) - sum(c) ** 2 / len(c) for g in own if g for c in zip(*g, strict=True))
        if best is None or scatter < best[1]:
            best = labels, scatter
    return best[0]


def clusters(chrom, a, b, covered, extra, name=None):
    """(positions, depths, [(scaled mean, scaled least, first, last)] of the clusters there are) of [a, b)."""
    depth, clips = covered
    at = list(range(a, b))
    d = [depth.get((chrom, p), 0) for p in at]
    inner = range(30, len(at) - 30 - extra)
    points = np.array([(at[k], 5 * sorted(d[k - 30 : k + 31])[30], clips.get((chrom, at[k]), 0)) for k in inner], float).reshape(-1, 3)
    n = len(points)
    labels = np.zeros(n, int) if n < 3 else best_of(points, name, 10) if name else lloyd(points, [n * (2 * k + 1) // 6 for k in range(3)])
    found = [(points[labels == k][:, 1].mean(), points[labels == k][:, 1].min(), int(points[labels == k][0, 0]), int(points[labels == k][-1, 0])) for k in range(3) if (labels == k).any()]
    return at, d, found


def walked(at, d, left, right, threshold):
    i, k = at.index(left), at.index(right)
    while i > 0 and d[i] <= threshold:
        i -= 1
    while k < len(at) - 1 and d[k] <= threshold:
        k += 1
    return at[i], at[k]


def test_refined_boundaries_equal_plain_loops(spark, covered):
    got = {r.region_id: (r.start, r.end, r.refined) for r in q.QUERIES["refined_boundaries"](spark, SF).collect()}
    refined = 0
    for r in q._regions(spark, SF).collect():
        want = (r.start, r.end, False)
        if r.start >= 200 and r.end > r.start:
            at, d, found = clusters(r.chrom, r.start - 200, r.end + 200, covered, 0)
            if len(found) == 3:
                stats = sorted((m / 5 // 1, -k, least // 5, left, right) for k, (m, least, left, right) in enumerate(found))
                low, middle, high = stats
                if low[0] < 4 * middle[0] // 5 and low[0] < 4 * high[0] // 5 and low[3] > min(s[3] for s in stats) and low[4] < max(s[4] for s in stats):
                    want = (*walked(at, d, low[3], low[4], middle[2]), True)
                    refined += 1
        assert got.pop(r.region_id) == want, r.region_id
    assert not got and refined


def test_refined_dataset_follows_the_refined_boundaries(spark):
    windows = {}
    for r in q.QUERIES["refined_boundaries"](spark, SF).collect():
        if r.chrom in ("X", "Y"):
            continue
        size = r.end - r.start
        size = 4 * size // 5 if size > 700 else size
        for kind, a, b in (("del", r.start, r.end), ("up", r.start - size - 150, r.start - 150), ("down", r.end + 150, r.end + 150 + size)):
            for w in range(a, b, 50):
                if w >= 0 and min(w + 50, b) - w >= 25:
                    windows[f"{r.region_id}_{kind}_{w}"] = (r.chrom, w, min(w + 50, b), int(kind == "del"), "train" if r.chrom in variants.TRAIN else "validation")
    got = {r.window_id: tuple(r)[1:] for r in q.QUERIES["refined_dataset_job"](spark, SF).collect()}
    assert got == windows


def test_candidates_equal_plain_loops(spark, covered):
    got = {r.region_id: (r.left, r.right) for r in q.QUERIES["deletion_candidates"](spark, SF).collect()}
    want = {}
    for r in q.contig_lengths(spark, SF).collect():
        for a in range(0, r.length, 2000):
            b = min(a + 2000, r.length)
            at, d, found = clusters(r.chrom, a, b, covered, 1, f"{r.chrom}_scan_{a}")
            if len(found) == 3:
                low, middle, high = sorted((m, k, least, left, right) for k, (m, least, left, right) in enumerate(found))
                if low[0] < 4 * middle[0] // 5 and low[0] < 4 * high[0] // 5:
                    want[f"{r.chrom}_scan_{a}"] = walked(at, d, low[3], low[4], middle[2] // 5)
    assert want and got == want


def test_contexts_equal_numpy(spark):
    rows = q._region_contexts(spark, SF).join(q._regions(spark, SF).selectExpr("region_id AS window_id", "chrom"), "window_id").collect()
    x = np.array([r.context_raw for r in rows], float)
    train = x[[r.chrom in variants.TRAIN for r in rows]]
    values, vectors = np.linalg.eigh(np.cov(train.T))
    got = {r.window_id: r.context for r in q.QUERIES["pca_context"](spark, SF).collect()}
    assert set(got) == {r.window_id for r in rows}
    reduced = np.array([got[r.window_id] for r in rows])
    centred = reduced - reduced[[r.chrom in variants.TRAIN for r in rows]].mean(axis=0)
    loadings, *_ = np.linalg.lstsq(x - train.mean(axis=0), centred, rcond=None)
    assert np.allclose(np.abs((loadings * vectors[:, ::-1][:, : context.COMPONENTS]).sum(axis=0)), 1, atol=1e-3)  # up to their signs the same axes
    assert (loadings[np.abs(loadings).argmax(axis=0), range(context.COMPONENTS)] > 0).all()
    assert np.allclose(centred, (x - train.mean(axis=0)) @ loadings, atol=1e-4)


def test_classifier_is_at_the_optimum(spark):
    """The gradient of the weighted, regularised loss vanishes at the fitted coefficients."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 3)) * [1, 2, 0.5]
    y = (rng.random(600) < 1 / (1 + np.exp(-(x @ [1.0, -0.7, 0.4] - 1)))).astype(int)
    rows = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, label int")
    weights = {r.label: r.weight for r in sampling.class_weights(rows).collect()}
    model = scoring.fit_classifier(rows.join(sampling.class_weights(rows).select("label", "weight"), "label"), ["a", "b", "c"]).stages[-1]
    w, c, bias = np.array([weights[k] for k in y]), model.coefficients.toArray(), model.intercept
    p = 1 / (1 + np.exp(-(x @ c + bias)))
    mean = (w @ x) / w.sum()
    spread = np.sqrt((w @ (x - mean) ** 2) / w.sum())
    gradient = np.r_[x.T @ (w * (p - y)) / w.sum() + 1e-3 * c * spread**2, w @ (p - y) / w.sum()]
    assert np.abs(gradient).max() < 2e-3


def test_fitted_classifier_beats_a_constant(spark):
    rows = q.QUERIES["fitted_classifier"](spark, SF.replace("0.001", "0.01")).collect()
    y, p = np.array([r.label for r in rows]), np.array([r.prob for r in rows])
    assert ((p > 0) & (p < 1)).all() and p[y == 1].mean() >= p[y == 0].mean()
    assert all(r.pred == int(r.prob > 0.5) for r in rows)
