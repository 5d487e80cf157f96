"""Vectors, url filters, archives and components against brute force, with odd rows."""

import base64
import hashlib
import re
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from delspan.llm import additive_quantisation, embedding_dedup, url_filters, warc
from delspan.llm.components import connected_components
from delspan.llm.queries import ORACLES, QUERIES
from tests.compare import SF, assert_same

VECTORS = "vec_id long, embedding array<double>, label int, n string, id string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", "y") for i, v in rows], VECTORS)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5000), (7, None), *((9000, k) for k in range(6000, 6200))]
    got = {r.id: r.component_id for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {x: x for e in edges if None not in e for x in e}
    for _ in range(300):
        for a, b in edges:
            if a is not None and b is not None:
                label[a] = label[b] = min(label[a], label[b])
    alone = {5000}
    assert got == {k: v for k, v in label.items() if k not in alone and not (v == k and all(k not in e or e == (k, k) for e in edges))}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("dense, bucket", [(4, 1024), (0, 1024), (4, 2), (10**6, 2)])
def test_embedding_dedup_equals_brute_force(spark, monkeypatch, dense, bucket):
    """With few and many dense buckets, large and small ones, split into blocks."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    monkeypatch.setattr(embedding_dedup, "DENSE", dense)
    monkeypatch.setattr(embedding_dedup, "BUCKET", bucket)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 16))
    near = x[:1] + rng.normal(size=(60, 16)) * 0.04
    x = np.concatenate([x, near, x[3:4], x[3:4], 2 * x[4:5]])
    rows = [(i, v) for i, v in enumerate(x)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [None] + [1.0] * 15), (904, [float("nan")] * 16), (905, [float("inf")] + [1.0] * 15), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, x[0])]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(vectors(spark, rows)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.minimum(label, np.where(link, label[None, :], len(x)).min(axis=1))
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), label[i], label[i] == i)
    assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k in range(900, 906))
    assert got[907].component_id == 906 and got[906].n_links == 1
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    assert embedding_dedup.near_duplicates(vectors(spark, [])).count() == 0


def test_embedding_dedup_query_equals_sql(spark):
    assert_same(QUERIES["op4_embedding_dedup"](spark, SF), ORACLES["op4_embedding_dedup"])


def test_close_pairs_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 64))
    y = rng.normal(size=(2000, 64))
    u, v = embedding_dedup.unit(x), embedding_dedup.unit(y - (embedding_dedup.unit(x) * y).sum(axis=1, keepdims=True) * embedding_dedup.unit(x))
    near = 0.95 * u + np.sqrt(1 - 0.95**2) * v
    _, a = embedding_dedup.signatures(u, 6, 9, 7)
    _, b = embedding_dedup.signatures(near, 6, 9, 7)
    limit = embedding_dedup.most_apart(0.95)
    assert np.bitwise_count(a ^ b).sum(axis=1).max() <= limit
    assert np.bitwise_count(a[1:] ^ a[:-1]).sum(axis=1).min() > limit
    bits, tables = embedding_dedup.plan(50_000)
    codes = [embedding_dedup.signatures(z, bits, tables, 7)[0] for z in (u, near)]
    assert (codes[0] == codes[1]).any(axis=1).mean() >= 0.995


def test_nearest_neighbours_recall(spark):
    sf = SF.replace("0.001", "0.1")
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    got: dict = {}
    for r in QUERIES["op2_nearest_neighbours"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = []
    for q in ids[ids % 20 == 0].tolist():
        scores = x @ x[ids == q][0]
        order = [int(i) for i in ids[np.lexsort((ids, -scores))] if i != q][:20]
        assert len(got[q]) == 20 and q not in dict(got[q])
        assert all(abs(s - scores[ids == i][0]) < 1e-12 for i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
        hits.append(len(set(order) & {i for i, _ in got[q]}) / 20)
    assert np.mean(hits) >= 0.9


def test_nearest_neighbours_odd_rows(spark):
    rows = [(20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (2, [0.5, 1.0]), (40, None), (5, [None, 1.0]), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (60, [1.0, 1.0, 1.0]), (None, [1.0, 0.0])]
    got = additive_quantisation.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(20, 1, 3, 1.0), (20, 2, 4, 1.0), (20, 3, 2, 0.5)]  # ties to the smaller id; all, if fewer than k
    many = [(20, [1.0, 0.5])] + [(i, [1.0, 0.5]) for i in range(100, 200)] + [(i, [0.9, 0.5]) for i in range(300, 340)]
    got = additive_quantisation.nearest(vectors(spark, many), F.col("vec_id") == 20).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [*range(100, 120)]
    assert additive_quantisation.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    two = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [0.9, 0.1]), (2, [0.1, 0.8]), (2, [0.2, 0.1])]  # ids with two vectors: the better score counts
    got = additive_quantisation.nearest(vectors(spark, two), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(1, 1, 0.9), (2, 2, 0.8)]


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = rest[:cut].translate(str.maketrans(url_filters.UPPER, url_filters.LOWER))
    rest = rest[cut:]
    return host, rest[: min([rest.index(c) for c in "?#" if c in rest] or [len(rest)])]


def brute_rule(host, path):
    fits = [r for r in url_filters.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return (best[1] + best[2], best[0]) if best else (None, None)


def test_url_rules_equal_brute_force(spark):
    urls = [None, "", "example.com/en/", "://", "http://A.COM", "http://a.com/", "http://com/x", "http://xcom/y", "http://WWW.example.com/en/1?x#y", "http://example.com/en/", "http://example.com/en", "http://b.example.com/en/2", "https://x.net/es/3", "https://x.net/ES/3", "https://net/fr/", "http://É.net/fr/é", "a://b://c.com/", "http://x.com?q=/en/", "http://x.com#/a", "http://x.org/en/1\nz", "http://user@h.com:80/p"]
    rows = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, segments string")
    got = {r.page_id: r for r in url_filters.judge(rows).collect()}
    for i, u in enumerate(urls):
        host, path = brute_url(u)
        rule, verdict = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (verdict or "allow")
    assert url_filters.judge(rows.limit(0)).count() == 0


def test_url_query(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op7_url_filters"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        host, path = brute_url(r.url)
        rule, verdict = brute_rule(host, path)
        assert (got[r.page_id].host, got[r.page_id].path, got[r.page_id].rule) == (host, path, rule)
        assert got[r.page_id].verdict in ("allow", "block") and (verdict is None or got[r.page_id].verdict == verdict)


def brute_trees(pages):
    """(template, blocked) for each (host, segments) by plain trees, level by level; pages: (host, segments, verdict)."""
    count: dict = {}
    for host, segments, verdict in pages:
        c = count.setdefault((host, segments), [0, 0, 0])
        c[0] += 1
        c[1] += verdict is not None
        c[2] += verdict == "block"
    at = dict.fromkeys(count, "")
    for level in range(url_filters.DEPTH):
        children: dict = {}
        for (host, segments), c in count.items():
            if level < len(segments):
                below = "/".join(re.sub(r"[^#*.]+", "a", s) for s in segments[level + 1 :])
                child = children.setdefault((host, at[host, segments]), {}).setdefault(segments[level], [0, 0, 0, []])
                for k in range(3):
                    child[k] += c[k]
                child[3].append(below)
        branch = {}
        for node, own in children.items():
            every, bad = sum(c[1] for c in own.values()), sum(c[2] for c in own.values())
            share = (bad + url_filters.PRIOR / 2) / (every + url_filters.PRIOR)
            rare = sum(c[0] <= 2 for c in own.values())
            variable = len(own) > url_filters.MAX_CHILDREN and rare >= url_filters.RARE * len(own)
            classes: dict = {}
            for segment, (_, labelled, blocked, below) in own.items():
                n = max(labelled, 1)
                off = (blocked / n - share) / max((share * (1 - share) / n) ** 0.5, 1e-9)
                kind = "unlabelled" if not labelled else "above" if off > url_filters.ERRORS else "below" if off < -url_filters.ERRORS else "like"
                classes.setdefault("*" + kind if variable else "|".join([kind, min(below), max(below)]), []).append(segment)
            branch |= {(node, s): "{" + name + "}" if len(like) > 1 else s for name, like in classes.items() for s in like}
        at = {(host, segments): a if level >= len(segments) else f"{a}/{branch[(host, a), segments[level]]}" for (host, segments), a in at.items()}
    labelled: dict = {}
    for (host, segments), c in count.items():
        sums = labelled.setdefault((host, at[host, segments]), [0, 0])
        sums[0] += c[1]
        sums[1] += c[2]
    purity = {t: (bad + url_filters.PRIOR / 2) / (n + url_filters.PRIOR) for t, (n, bad) in labelled.items()}
    return {key: (at[key], purity[key[0], at[key]] > url_filters.LIMIT) for key in count}


def brute_shape(path):
    plain = re.sub(r"[0-9]+", "#", re.sub(r"[0-9a-fA-F]{16,}|[A-Za-z0-9_-]{40,}", "*", path))
    return tuple(re.sub("^/", "", plain).split("/", url_filters.DEPTH - 1))


def test_templates_equal_plain_trees(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "MAX_CHILDREN", 6)
    rng = np.random.default_rng(9)
    words = ["ads", "news", "en", "fr", "shop", "a.html", "item-7", "item-8", "item-9", "0123456789abcdef0", *(f"slug{chr(97 + k)}" for k in range(20))]
    urls = []
    for _ in range(700):
        depth = int(rng.integers(0, 6))
        urls.append("http://" + rng.choice(["h.org", "g.org", "x.net", "www.x.net"]) + "".join("/" + rng.choice(words[int(rng.choice([0, 5])) : int(rng.choice([8, 30]))]) for _ in range(depth)) + rng.choice(["", "/", "?q"]))
    rules = (("block", "h.org", "/ads"), ("allow", "h.org", "/news"), ("block", "h.org", "/item-7"), ("block", "x.net", "/item-9"), ("block", "net", "/fr/"), ("allow", "www.x.net", "/fr/slug"), ("block", "g.org", "/shop/ads"), ("allow", "g.org", "/shop/"))
    monkeypatch.setattr(url_filters, "RULES", rules)
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filters.judge(rows, rules).collect()}
    parts = [brute_url(u) for u in urls]
    ruled = [brute_rule(*p) for p in parts]
    trees = brute_trees([(h, brute_shape(p), v) for (h, p), (_, v) in zip(parts, ruled, strict=True)])
    for i, ((host, path), (rule, verdict)) in enumerate(zip(parts, ruled, strict=True)):
        template, blocked = trees[host, brute_shape(path)]
        assert (got[i].rule, got[i].template, got[i].verdict) == (rule, template, verdict or ("block" if blocked else "allow")), urls[i]
    by_tree = [trees[h, brute_shape(p)][1] for (h, p), (_, v) in zip(parts, ruled, strict=True) if v is None]
    assert any(by_tree) and not all(by_tree)


def test_templates_learn_from_labels(spark):
    """Pages of a template whose labelled pages are blocked are blocked too; unlabelled templates stay."""
    rules = (("block", "h.org", "/ads/1"), ("allow", "h.org", "/news/1"))
    urls = [f"http://h.org/ads/{n}" for n in range(100, 200)] + [f"http://h.org/ads/{n}" for n in range(200, 240)] + [f"http://h.org/news/{n}" for n in range(100, 300)] + [f"http://h.org/user{k}/x" for k in range(60)]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = [r.verdict for r in url_filters.judge(rows, rules).orderBy("page_id").collect()]
    assert got[:140] == ["block"] * 140 and set(got[140:]) == {"allow"}
    names = {r.template for r in url_filters.judge(rows, rules).where("page_id >= 340").collect()}
    assert len(names) == 1  # many rare children of a node are one wildcard


PAGES = "page_id long, url string, html string, digest string, refers_to string"


def test_archives_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 40_000
    rows = [(1, "http://a/1", "x"), (2, "http://a/2", "x"), (3, None, None), (4, "http://a/4 b\r\n", ""), (5, "u", big), (6, "u", "y"), (None, "u", "x"), (None, None, "z"), (2, "http://a/2", "x"), (7, "u", "x" * 10)]
    df = spark.createDataFrame([(*r, "d", "r") for r in rows], PAGES)
    path = warc.write_archives(df.repartition(3), str(tmp_path / "w"))
    got = warc.read_archives(spark, path).collect()
    plain = sorted(((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got), key=str)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    last = {"x": 2, "": 4}
    want = sorted(((i is None, i or 0, "revisit" if i is not None and last.get(h or "", i) != i else "response", last[h or ""] if i is not None and last.get(h or "", i) != i else None, len((h or "").encode()), digest(h)) for i, _, h in rows), key=str)
    assert plain == want
    assert {r.payload for r in got if r.page_id == 5} == {big} and {r.payload for r in got if r.page_id == 1} == {None}
    kept = warc.write_archives(df, str(tmp_path / "v"), min_bytes=5)
    assert {r.record_type for r in warc.read_archives(spark, kept).collect()} == {"response"}
    assert warc.read_archives(spark, warc.write_archives(df.limit(0), str(tmp_path / "e"))).count() == 0


def test_archives_are_read_by_the_library(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<html><body>{'text ' * (i % 50)}page {i}</body></html>") for i in range(900)]
    df = spark.createDataFrame([(*r, "d", "r") for r in rows], PAGES)
    path = warc.write_archives(df, str(tmp_path / "w"))
    seen = 0
    for f in (tmp_path / "w").glob("part-*"):
        data = f.read_bytes()
        magic, size = struct.unpack_from("<II", data)
        assert magic == warc.DICTIONARY_MAGIC
        trained = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
        text = zstandard.ZstdDecompressor(dict_data=trained).stream_reader(data, read_across_frames=True).read()
        seen += text.count(b"WARC/1.1\r\n")
    assert seen == 900 and warc.read_archives(spark, path).count() == 900


def test_broken_archives(spark, tmp_path):
    good = warc.record(1, "u", b"abc")
    z = zstandard.ZstdCompressor(write_checksum=True)
    cases = {
        "length": good.replace(b"Content-Length: 81", b"Content-Length: 80"), "digest": good.replace(b"abc", b"abd"), "version": good.replace(b"WARC/1.1", b"WARK/1.1"),
        "header": good.replace(b"WARC-Date: ", b"WARC Date: "), "missing": good.replace(b"WARC-Type: response\r\n", b""), "end": good[:-2],
    }
    assert len({*cases.values(), good}) == len(cases) + 1
    for name, data in cases.items():
        folder = tmp_path / name
        folder.mkdir()
        (folder / "a.warc.zst").write_bytes(z.compress(good) + z.compress(data))
        found = warc.read_archives(spark, str(folder), strict=False).collect()
        assert [r.error is None for r in found] == [True, False], name
    assert [warc.parse(x)["payload"] for x in warc.frames(z.compress(good) + warc.SEPARATOR.encode() + z.compress(good))] == ["abc", "abc"]
    for bad in (z.compress(good)[:-3], b"nonsense", warc.SEPARATOR.encode()[:5]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.frames(bad))
    with pytest.raises(ValueError):
        list(warc.frames(warc.SEPARATOR.encode() + struct.pack("<II", warc.DICTIONARY_MAGIC, 0)))


def test_warc_archives_are_bounded(spark, tmp_path):
    rng = np.random.default_rng(4)
    texts = [rng.bytes(int(n)).hex() for n in rng.integers(10, 3_000, 700)] + [rng.bytes(90_000).hex()]
    df = spark.createDataFrame([(k, f"http://h/{k}", x) for k, x in enumerate(texts)], "page_id long, url string, html string").coalesce(2)
    path = warc.write_archives(df, str(tmp_path / "w"), archive_bytes=100_000)
    sizes = sorted(x.stat().st_size for x in (tmp_path / "w").glob("part-*"))
    assert len(sizes) > 6 and sizes[-2] < 105_000 and sizes[-1] < 200_000
    for x in (tmp_path / "w").glob("part-*"):
        assert struct.unpack("<I", x.read_bytes()[:4])[0] == warc.DICTIONARY_MAGIC
    got = {r.page_id: (r.payload, r.record_type) for r in warc.read_archives(spark, path).collect()}
    assert got == {k: (x, "response") for k, x in enumerate(texts)}


def test_archives_query_equals_sql(spark):
    assert_same(QUERIES["op8_warc"](spark, SF), ORACLES["op8_warc"])
