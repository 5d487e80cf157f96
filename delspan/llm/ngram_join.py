"""Operator 10: similarity join on word shingles by Jaccard, with prefix filters under several orders of all tokens.

Two sets with Jaccard similarity ``t`` or more share a token among the first ``n - ceil(t n) + 1`` of each, under any order of
all tokens. A pair is verified only if it passes this filter under the first order and under each of ``ORDERS`` further ones.

* Documents with equal sets are one class from the start.
* The first order puts rare tokens first, by exact counts over the whole table. Only a part of the tokens, the *pool*, is counted: those
  with a hash below ``POOL`` times what a prefix needs. The pool stands before all other tokens, ordered by (count, hash); the others follow by
  hash. That is one order of all tokens, so the filter is exact, and a class has to send little more than its prefix to be counted.
  A token that one class has joins nothing, so most classes end here: their prefixes hold such tokens only.
* The classes that share a token are compared in blocks of ``BLOCK``; sizes and 512-bit parity sketches (a lower bound of the
  symmetric difference, so no link is lost) leave out what can't link.
* Where more than ``DENSE`` times as many pairs as classes are left in a block, a first round takes a spanning forest of the closest pairs only. The
  second round takes all pairs of such blocks whose classes the first round's links didn't connect, and has sketches of four bits and more for each
  shingle, which leave few pairs but those that link. So every pair that can link is either verified or already in one component.
* The further orders are hashes. Candidates are sifted by long sketches and by the prefixes under all these orders before any set
  travels. Sketches, prefixes and sets travel to the pairs' tasks once for each pair of blocks of documents, not once for each pair. Classes stand
  in blocks by the token of their prefix that most classes share, at most about ``SET_BLOCK`` classes and ``SET_BYTES`` bytes to a block; parts
  are counted from what travels, and a pair of large blocks is a part of its own.

Defined results: documents without words, or null texts, have no shingles and link with nothing; equal shorter texts link
through their one shingle; a null id links with nothing and has a null component; repeated rows have the same
component; rows of one id with different texts are documents of their own; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, give_back, keep_only, lean, materialize, partitions_for
from .components import connected_components
from .shingles import digest, mix, shingle_sets

ORDERS = 2
POOL = 2.5
BLOCK, SMALL, DENSE = 1_024, 24, 4
SET_BLOCK, SET_BYTES = 256, 2 << 20
PART_BYTES = 12 << 20
#: XORed bytes of sketches at a time.
AT_ONCE = 16 << 20


def prefix_length(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    return n - -(-percent * n // 100) + 1


def pool_limit(percent: int) -> int:
    """Tokens of the pool have an id below this, of 2^63."""
    return min(int(POOL * (100 - percent) / 100 * (1 << 63)), (1 << 63) - 1)


def token_ids(shingles: np.ndarray, order: int = 0) -> np.ndarray:
    """Each shingle's hash under an order, below 2^63."""
    return (mix(shingles, 1 if order == 0 else 2 + order) >> np.uint64(1)).view(np.int64)


def counted_tokens(shingles: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, how many are each set's, prefix lengths): the ids of the pool, and the next ones by hash where a set's prefix needs more."""
    ids = token_ids(shingles)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    need = np.where(sizes > 0, prefix_length(sizes, percent), 0)
    sent = ids < pool_limit(percent)
    upto = np.r_[0, np.cumsum(sent)]
    for k in np.flatnonzero(upto[ends] - upto[begins] < need).tolist():
        own = slice(begins[k], ends[k])
        sent[own] = ids[own] <= np.partition(ids[own], need[k] - 1)[need[k] - 1]
    upto = np.r_[0, np.cumsum(sent)]
    return ids[sent], upto[ends] - upto[begins], need


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of buckets of tokens: 512 at least, and four for each token. Halving it (:func:`folded`) gives the smaller sketch."""
    bits = 512
    while bits < 4 * len(shingles):
        bits *= 2
    return np.packbits(np.bincount((mix(shingles, 2) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def folded(bits: bytes | np.ndarray, size: int = 64) -> np.ndarray:
    """The sketch brought to ``size`` bytes."""
    x = np.frombuffer(bits, np.uint8) if isinstance(bits, bytes) else bits
    return np.bitwise_xor.reduce(x.reshape(-1, size), axis=0)


def further_prefixes(shingles: np.ndarray, percent: int) -> list[bytes]:
    """The first tokens under each further order, as 32 of their bits: equal tokens have equal ones, so no pair is lost."""
    size = prefix_length(len(shingles), percent)
    out = []
    for k in range(ORDERS):
        ids = token_ids(shingles, k + 1)
        out.append((np.partition(ids, size - 1)[:size] & 0xFFFFFFFF).astype(np.uint32).tobytes())
    return out


class _Sketches:
    """Sketches of some classes, to be compared at the size that both of a pair have."""

    def __init__(self, bits: list[bytes]) -> None:
        self.bits = bits
        self.size = np.fromiter(map(len, bits), np.int64, len(bits))
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _table(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size not in self.at:
            rows = np.flatnonzero(self.size >= size)
            row_of = np.full(len(self.bits), -1)
            row_of[rows] = np.arange(len(rows))
            table = [np.frombuffer(self.bits[k], np.uint8) if self.size[k] == size else folded(self.bits[k], size) for k in rows.tolist()]
            self.at[size] = row_of, np.stack(table).view(np.uint64)
        return self.at[size]

    def far(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least symmetric difference of each pair."""
        size = np.minimum(self.size[a], self.size[b])
        out = np.empty(len(a), np.int64)
        for s in np.unique(size).tolist():
            row_of, table = self._table(s)
            which = np.flatnonzero(size == s)
            for k in range(0, len(which), max(1, AT_ONCE // s)):
                part = which[k : k + max(1, AT_ONCE // s)]
                out[part] = np.bitwise_count(table[row_of[a[part]]] ^ table[row_of[b[part]]]).sum(axis=1, dtype=np.int64)
        return out


def _may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, sketches: _Sketches, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of the pairs may link, their least symmetric difference)"""
    na, nb = n[a], n[b]
    far = sketches.far(a, b)
    # J >= p/100 means |A n B| >= p / (100 + p) (|A| + |B|), so the difference is at most (100 - p) / (100 + p) (|A| + |B|)
    return (np.minimum(na, nb) * 100 >= percent * np.maximum(na, nb)) & (far * (100 + percent) <= (100 - percent) * (na + nb)), far


def _block_pairs(side: np.ndarray, n: np.ndarray, sketches: _Sketches, label: np.ndarray, percent: int, every: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of one piece of work that may link and have different labels; unless ``every``, a spanning forest if there are many."""
    first = np.flatnonzero(side == 0)
    across = len(first) < len(side)
    second = np.flatnonzero(side == 1) if across else first
    left, right, gap = [], [], []
    for s in range(0, len(first), 128):
        a, b = np.meshgrid(first[s : s + 128], second, indexing="ij")
        a, b = a.ravel(), b.ravel()
        keep = (label[a] != label[b]) & (np.minimum(n[a], n[b]) * 100 >= percent * np.maximum(n[a], n[b]))
        if not across:
            keep &= a < b
        a, b = a[keep], b[keep]
        ok, far = _may_link(a, b, n, sketches, percent)
        left.append(a[ok]), right.append(b[ok]), gap.append(far[ok])
    a, b, far = map(np.concatenate, (left, right, gap))
    if every or len(a) <= DENSE * len(side):
        return a, b, False
    chosen = _forest(a, b, far, label)
    return a[chosen], b[chosen], True


def _forest(a: np.ndarray, b: np.ndarray, far: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which pairs make up a spanning forest of least distances: each component takes its closest pair out, until none is left."""
    _, part = np.unique(label, return_inverse=True)
    order = np.argsort(far, kind="stable")
    u, v, chosen = part[a[order]], part[b[order]], []
    alive = np.arange(len(order))
    count = part.max() + 1
    root = np.arange(count)
    while len(alive):
        first = np.full(count, len(order))
        np.minimum.at(first, u, alive)
        np.minimum.at(first, v, alive)
        picked = np.unique(first[first < len(order)])
        chosen.append(order[picked])
        x, y = part[a[order[picked]]], part[b[order[picked]]]
        while True:  # least label over the picked pairs
            new = root.copy()
            low = np.minimum(root[x], root[y])
            np.minimum.at(new, root[x], low)
            np.minimum.at(new, root[y], low)
            new = new[new][root]
            if (new == root).all():
                break
            root = new
        u, v = root[part[a[order[alive]]]], root[part[b[order[alive]]]]
        alive = alive[u != v]
        u, v = root[part[a[order[alive]]]], root[part[b[order[alive]]]]
    return np.sort(np.concatenate(chosen))


def _candidates(shared: DataFrame, percent: int, every: bool) -> DataFrame:
    """``a, b, token`` from ``token, cls, n, sketch, label, blocks``: pairs to verify, and tokens of dense pieces of work (a and b null)."""
    spark = shared.sparkSession
    block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, block).alias("i"), F.greatest(k, block).alias("j"), (block > k).cast("int").alias("side")))
    work = shared.withColumn("p", F.explode(others)).select("token", "p.i", "p.j", "p.side", "cls", "n", "label", "sketch")
    key = ["token", "i", "j"]
    work = work.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key)

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        token, i, j, side, cls, n, label = (table.column(k).to_numpy() for k in range(7))
        sketches = _Sketches(table.column(7).to_pylist())
        new = np.r_[True, (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(token)])
        group = np.cumsum(new) - 1
        small = (sizes <= SMALL)[group]
        left, right, dense = [], [], []
        for lag in range(1, SMALL):
            a = np.flatnonzero(small[lag:] & (group[lag:] == group[:-lag]))
            if not len(a):
                break
            for s in range(0, len(a), 1 << 16):
                x = a[s : s + (1 << 16)]
                y = x + lag
                ok = (label[x] != label[y]) & ((side[x] != side[y]) | (i[x] == j[x])) & (np.minimum(n[x], n[y]) * 100 >= percent * np.maximum(n[x], n[y]))
                x, y = x[ok], y[ok]
                ok, _ = _may_link(x, y, n, sketches, percent)
                left.append(cls[x[ok]]), right.append(cls[y[ok]])
        for g in np.flatnonzero(sizes > SMALL):
            rows = slice(starts[g], starts[g] + sizes[g])
            a, b, many = _block_pairs(side[rows], n[rows], _Sketches(sketches.bits[rows]), label[rows], percent, every)
            left.append(cls[rows][a]), right.append(cls[rows][b])
            if many:
                dense.append(token[starts[g]])
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64())], ["a", "b", "token"])
        if dense:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(dense), pa.int64()), pa.nulls(len(dense), pa.int64()), pa.array(np.array(dense))], ["a", "b", "token"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, rows]) if held is not None else rows
            token, i, j = (held.column(k).to_numpy() for k in range(3))
            same = np.flatnonzero((token != token[-1]) | (i != i[-1]) | (j != j[-1]))
            cut = int(same[-1]) + 1 if len(same) else 0  # the last piece of work may go on in the next batch
            if cut:
                yield from solve(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield from solve(held)

    return work.mapInArrow(lean(run), "a long, b long, token long")


def _loads(placed: DataFrame, of: DataFrame) -> DataFrame:
    """``pair, bytes``: the bytes of the classes that the pairs ``a, b`` of each pair of blocks need, each once. of: cls, bytes"""
    wanted = placed.select("pair", F.col("a").alias("cls")).unionAll(placed.select("pair", F.col("b").alias("cls"))).distinct()
    return materialize(wanted.join(of, "cls").groupBy("pair").agg(F.sum("bytes").alias("bytes")), "loads")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (``u, v``) among ``pairs`` (``a, b``) of classes, as far as needed to connect what they connect. sets: cls, head, n, long_sketch, prefixes, shingles"""
    spark = pairs.sparkSession
    needed = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select(F.col("b").alias("cls"))).distinct()
    needed = materialize(needed.join(sets.select("cls", "head", "n"), "cls"), "needed")
    # classes with the same most shared token stand together, in blocks of bounded size
    heads = needed.groupBy("head").agg(F.ceil(F.greatest(F.count("*") / SET_BLOCK, F.sum("n") * 8 / SET_BYTES)).alias("k"))
    home = needed.join(heads, "head").select("cls", F.xxhash64("head", F.pmod(F.xxhash64("cls"), F.col("k"))).alias("home"))
    home = materialize(home, "home")

    def dealt(pairs: DataFrame, of: DataFrame) -> DataFrame:
        """``a, b, part``: pairs of two blocks of classes in one part; parts of a bounded number of bytes. of: cls, bytes"""
        placed = pairs.join(home.select(F.col("cls").alias("a"), F.col("home").alias("ha")), "a").join(home.select(F.col("cls").alias("b"), F.col("home").alias("hb")), "b")
        placed = materialize(placed.select("a", "b", F.xxhash64(F.least("ha", "hb"), F.greatest("ha", "hb")).alias("pair")), "paired")
        loads = _loads(placed, of)
        parts = partitions_for(spark, loads.agg(F.sum("bytes")).first()[0] or 0, PART_BYTES)
        part = F.when(F.col("bytes") * 4 > PART_BYTES, F.col("pair")).otherwise(F.pmod("pair", F.lit(parts)))
        out = materialize(placed.join(loads, "pair").select("a", "b", part.alias("part")), "placed")
        discard(placed, loads)
        return out

    def shipped(placed: DataFrame, of: DataFrame) -> DataFrame:
        """The rows of ``of`` (cls, ...) once for each part that they are needed in, as ``at``."""
        wanted = placed.select(F.col("part").alias("at"), F.col("a").alias("cls")).unionAll(placed.select(F.col("part").alias("at"), F.col("b").alias("cls"))).distinct()
        return wanted.join(of, "cls")

    def sift(pairs: pd.DataFrame, classes: pd.DataFrame) -> pd.DataFrame:
        keep_only()
        ids = classes["cls"].to_numpy()
        order = np.argsort(ids)
        a, b = (order[np.searchsorted(ids, pairs[c].to_numpy(), sorter=order)] for c in ("a", "b"))
        keep, _ = _may_link(a, b, classes["n"].to_numpy(), _Sketches(classes["long_sketch"].tolist()), percent)
        seen: dict[int, list[set]] = {}

        def prefixes(k: int) -> list[set]:
            if k not in seen:
                seen[k] = [set(np.frombuffer(p, np.uint32).tolist()) for p in classes["prefixes"].iat[k]]
            return seen[k]

        for k in np.flatnonzero(keep).tolist():
            keep[k] = not any(p.isdisjoint(q) for p, q in zip(prefixes(a[k]), prefixes(b[k]), strict=True))
        give_back()
        return pd.DataFrame({"u": pairs["a"].to_numpy()[keep], "v": pairs["b"].to_numpy()[keep]})

    of = sets.select("cls", "n", "long_sketch", "prefixes")
    placed = dealt(pairs, needed.select("cls", (F.col("n") * (1 + 4 * ORDERS * (100 - percent) / 100) + 64).cast("long").alias("bytes")))
    kept = placed.groupBy("part").cogroup(shipped(placed, of).groupBy("at")).applyInPandas(sift, "u long, v long")
    pairs = materialize(kept.select(F.col("u").alias("a"), F.col("v").alias("b")), "sifted")
    discard(placed)
    left = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select(F.col("b").alias("cls"))).distinct()
    placed = dealt(pairs, needed.join(left, "cls").select("cls", (F.col("n") * 8).alias("bytes")))

    def compare(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        keep_only()
        known = {c: np.frombuffer(s, np.uint64) for c, s in zip(sets["cls"], sets["shingles"], strict=True)}
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        out = []
        for a, b in zip(pairs["a"].tolist(), pairs["b"].tolist(), strict=True):
            ra, rb = find(a), find(b)
            if ra == rb:
                continue
            x, y = known[a], known[b]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                out.append((a, b))
                root[max(ra, rb)] = min(ra, rb)
        give_back()
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    links = placed.groupBy("part").cogroup(shipped(placed, sets.select("cls", "shingles")).groupBy("at")).applyInPandas(compare, "u long, v long")
    links = materialize(links, "links")
    discard(placed, needed, home, pairs)
    return links


def _grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id, tk, n, group, component_id`` for each row of docs (doc_id, text); tk: the text's hash; group: null for rows that link with nothing."""
    key = dict(docs.dtypes)["doc_id"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("hashes")
        names = ["doc_id", "tk", "n", "digest", "slack", "tokens"]
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for s, e in chunks(texts):
                shingles, sizes = shingle_sets(texts[s:e], words)
                ends = np.cumsum(sizes)
                digests = [digest(shingles[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                ids, sent, need = counted_tokens(shingles, sizes, percent)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sent)].astype(np.int32)), pa.array(ids))
                part = batch.slice(s, e - s)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes), pa.array(digests, pa.binary()), pa.array((need - sent).astype(np.int32)), lists], names)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("hashes")
        names = ["cls", "head", "n", "sketch", "long_sketch", "prefixes", "shingles"]
        for batch in batches:
            texts, digests = batch.column(3).to_pylist(), batch.column(2).to_pylist()
            for s, e in chunks(texts):
                shingles, sizes = shingle_sets(texts[s:e], words)
                ends = np.cumsum(sizes)
                found = [shingles[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                mine = [k for k, x in enumerate(found) if digest(x) == digests[s + k]]
                at = pa.array([s + k for k in mine], pa.int64())
                long = [sketch(found[k]) for k in mine]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(sizes[mine]), pa.array([folded(x).tobytes() for x in long], pa.binary()), pa.array(long, pa.binary()), pa.array([further_prefixes(found[k], percent) for k in mine], pa.list_(pa.binary())), pa.array([found[k].tobytes() for k in mine], pa.binary())],
                    names,
                )

    docs = docs.select("doc_id", F.xxhash64("text").alias("tk"), "text")
    signed = docs.mapInArrow(lean(sign), f"doc_id {key}, tk long, n long, digest binary, slack int, tokens array<long>")
    signed = materialize(signed.withColumn("cls", F.monotonically_increasing_id()), "signed")
    part = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    members = materialize(signed.select("doc_id", "tk", "n", F.when(part, F.col("digest")).alias("digest"), "cls"), "members")
    # a class is named by one of its rows, of its least id
    classes = members.where("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "cls", "tk")).alias("own")).select("digest", "own.*")
    classes = materialize(classes, "classes")
    reps = materialize(signed.join(classes.select("cls"), "cls").select("cls", "slack", "tokens"), "reps")
    discard(signed)
    postings = reps.select("cls", "slack", F.explode("tokens").alias("token"))
    counts = materialize(postings.groupBy("token").agg(F.count("*").alias("m")).where("m > 1"), "counts")
    limit = pool_limit(percent)
    place = F.struct((F.col("token") >= limit).alias("late"), F.when(F.col("token") < limit, F.col("m")).otherwise(F.lit(0)).alias("m"), "token")
    hits = postings.join(counts, "token").groupBy("cls", "slack").agg(F.sort_array(F.collect_list(place)).alias("hits"))
    # tokens of this class only come before the hits, so the hits fill what these leave of the prefix
    prefix = F.slice("hits", F.lit(1), F.greatest(F.col("slack") + F.size("hits"), F.lit(0)))
    prefixes = materialize(hits.select("cls", F.explode(prefix).alias("p")).select("cls", "p.token"), "prefixes")
    discard(reps, counts)
    of_token = prefixes.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token", "m", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    shared = materialize(prefixes.join(of_token, "token"), "shared")
    discard(prefixes)
    heads = shared.groupBy("cls").agg(F.max(F.struct("m", "token")).alias("most")).select("cls", F.col("most.token").alias("head"))
    asked = classes.join(heads, "cls")
    sets = docs.join(asked, ["doc_id", "tk"]).select("cls", "head", "digest", "text").dropDuplicates(["cls"])
    sets = sets.mapInArrow(lean(describe), "cls long, head long, n long, sketch binary, long_sketch binary, prefixes array<binary>, shingles binary")
    sets = materialize(sets, "sets")

    def round_of(shared: DataFrame, column: str, every: bool) -> DataFrame:
        known = sets.select("cls", "n", F.col(column).alias("sketch"))
        return materialize(_candidates(shared.join(known, "cls"), percent, every), "second_pairs" if every else "first_pairs")

    found = round_of(shared.drop("m").withColumn("label", F.col("cls")), "sketch", every=False)
    links = _verify(materialize(found.where("token is null").select("a", "b").distinct(), "distinct_pairs"), sets, percent)
    dense = materialize(found.where("token is not null").select("token").distinct(), "dense")
    labels = connected_components(links)
    if not dense.isEmpty():
        again = shared.drop("m").join(dense, "token").join(labels.select(F.col("id").alias("cls"), F.col("component_id").alias("label")), "cls", "left")
        again = materialize(again.withColumn("label", F.coalesce("label", "cls")), "again")
        open_tokens = again.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("token")
        rest = round_of(again.join(open_tokens, "token"), "long_sketch", every=True)
        more = _verify(materialize(rest.select("a", "b").distinct(), "distinct_pairs"), sets, percent)
        labels = connected_components(links.unionAll(more))
    labelled = classes.join(labels.withColumnRenamed("id", "cls"), "cls", "left").withColumn("group", F.coalesce("component_id", "cls"))
    labelled = materialize(labelled.select("digest", "doc_id", "group"), "labelled")
    discard(shared, sets, found, links, classes)
    least = labelled.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return members.drop("cls").join(labelled.join(least, "group").select("digest", "group", "component_id"), "digest", "left")


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row; documents link from a Jaccard similarity of ``percent`` / 100."""
    found = _grouped(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), words, percent)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``df`` for each group of linked documents, that of the smallest id; rows that link with nothing, not even a copy, all stay.

    Of several rows of that id in one group, the one of the least text hash stays; rows without words or id stay as they are.
    """
    found = materialize(_grouped(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), words, percent).where("group is not null").select("doc_id", "tk", "group", "component_id"), "components")
    first = found.where("doc_id = component_id").groupBy("group", "doc_id").agg(F.min("tk").alias("tk"), F.count("*").alias("rows"))
    gone = found.where("doc_id <> component_id").select("doc_id", "tk").unionByName(found.join(first.where("rows > 1").withColumnRenamed("tk", "least"), ["group", "doc_id"]).where("tk <> least").select("doc_id", "tk")).distinct()
    repeated = found.groupBy("doc_id", "tk").count().where("count > 1").select("doc_id", "tk")
    named = lambda rows: rows.select(F.col("doc_id").alias("__gone_id"), F.col("tk").alias("__gone_tk"))
    same = (F.col("__gone_id") == df[id_col]) & (F.col("__gone_tk") == F.xxhash64(df[text_col]))
    kept = df.join(named(gone), same, "left_anti")
    if repeated.isEmpty():
        return kept
    once = kept.join(named(repeated), same, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(named(repeated), same, "left_anti").unionByName(once)


SIMILAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+2], ' ') FOR i IN range(1, len(w) - 1)]) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
e AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
c(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, c.r FROM c JOIN e ON e.u = c.id WHERE c.r < e.v)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CAST(min(c.r) AS BIGINT) AS component_id
FROM s JOIN c ON c.id = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
