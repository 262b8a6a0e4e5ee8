"""SimHash near-dedup with vantage-point trees.

Fingerprints: A-Z of the text lower-cased, words are runs of anything but ASCII white
space, shingles are three words joined by spaces (repeats count; a text of one or two
words is one shingle; a text without words has fingerprint zero), hashed by XXH64
with seed 42. A bit is set if it is set in over half of the hashes. Fingerprints with
at most ``RADIUS`` differing bits are linked; documents get the smallest doc_id that
links reach.

Linking: the different fingerprints (copies fall together first, so a group of exact
copies of any size is one) are dealt to shards, the leaves of a vantage-point tree
over Hamming distance. The tree is built on the driver from a bounded sample; a node
holds a vantage point and the median distance. A fingerprint x has one home leaf, and
by the triangle inequality everything within r of x lies in leaves that x reaches when
it goes left if d <= mu + r and right if d > mu - r: x visits those shards
as well. In a shard a second tree over its home fingerprints, with the same bounds,
finds all pairs exactly. A shard returns no pairs but a spanning forest: each
fingerprint with the smallest one that it is connected to there. Components over
all shards come from large-star / small-star rounds with a checkpoint each.

Plan: one scan of the texts (fingerprints are checkpointed, 16 bytes a row), a
pre-aggregated shuffle by fingerprint, one shuffle by shard, rounds over links only
(few), one join back by fingerprint that AQE splits where a fingerprint is hot. The
driver holds the sample (``SAMPLE`` fingerprints), never links or components.

Cost: a fingerprint visits more leaves as the tree deepens (random 64-bit words lie
near distance 32 of any vantage point, so a level multiplies visits by about 1.4), and
work grows as the number of different fingerprints to the power 1.5 at worst.

Defined results: null or empty text and text of white space = fingerprint zero, linked
like any other; repeated rows have equal rows; null doc_id never becomes a
component_id unless there is no other; a very long text is hashed in parts of 65,536
shingles; empty table = no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_of, without

RADIUS = 2
WORDS = 3
SEED = 42
#: Fingerprints that the top tree is built from at most, and those meant for a shard: a
#: sixteenth of all within these bounds (2 MB of words at most), as larger shards mean
#: shallower trees and fewer copies of each fingerprint in the shuffle.
SAMPLE, SHARDS, SMALL, LARGE = 1 << 16, 16, 1 << 14, 1 << 18
LEAF = 128
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, words: int = WORDS) -> int:
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return 0
    ones, n = np.zeros(64, np.int64), max(1, len(w) - words + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for lo in range(0, n, 65_536):
        h = np.array([digest(join(w[i : i + words]), SEED) for i in range(lo, min(n, lo + 65_536))], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (signed 64-bit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class VPTree:
    """A vantage-point tree over 64-bit words, or over rows with a metric of their own
    (whole numbers). Inner nodes: (vantage point, mu, left, right), left within mu;
    leaves: arrays of positions."""

    def __init__(self, words: np.ndarray, leaf: int, distance=_distance):
        self.words, self.leaves, self.distance = words, 0, distance
        self.root = self._build(np.arange(len(words)), leaf)

    def _build(self, at: np.ndarray, leaf: int):
        if len(at) > leaf:
            # Of a few candidates, the vantage point with the widest spread prunes best.
            some = self.words[at[:: max(1, len(at) // 200)]]
            spread = [(float(self.distance(some, self.words[i]).var()), -k, i) for k, i in enumerate(at[:: max(1, len(at) // 5)][:5])]
            vp = self.words[max(spread)[2]]
            d = self.distance(self.words[at], vp)
            mu = int(np.sort(d)[(len(d) - 1) // 2])
            inside = d <= mu
            if inside.all():
                mu -= 1
                inside = d <= mu
            if inside.any():
                return vp, mu, self._build(at[inside], leaf), self._build(at[~inside], leaf)
        self.leaves += 1
        return self.leaves - 1, at

    def visit(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Leaf number, positions in the leaf, and the queries that must look there."""
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, q = stack.pop()
            if not len(q):
                continue
            if len(node) == 2:
                yield node[0], node[1], q
                continue
            vp, mu, left, right = node
            d = self.distance(queries[q], vp).astype(np.int16)
            stack.append((right, q[d > mu - radius]))
            stack.append((left, q[d <= mu + radius]))


class Forest:
    """Union-find over 0..n-1 with array operations; the root is the smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        p = self.parent
        while (q := p[p]).tobytes() != p.tobytes():
            p = q
        self.parent = p
        return p

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            p = self.roots()
            x, y = p[a], p[b]
            apart = x != y
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            x, y = x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def connect(words: np.ndarray, home: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For ascending different words: the position of the smallest word that each is
    connected to by pairs of which one, at least, is at home here."""
    forest, own = Forest(len(words)), np.flatnonzero(home)
    tree = VPTree(words[own], LEAF)
    for _, at, q in tree.visit(words, radius):
        here = own[at]
        for lo in range(0, len(q), 4096):
            part = q[lo : lo + 4096]
            a, b = np.nonzero(_distance(words[part][:, None], words[here][None, :]) <= radius)
            a, b = part[a], here[b]
            far = a != b
            if far.any():
                forest.union(a[far], b[far])
    return forest.roots()


def links(different: DataFrame, n: int, radius: int = RADIUS, shard: int | None = None) -> DataFrame:
    """different: one column fp, no repeats. Links (a, b), b < a, of a spanning
    forest of the components of each shard."""
    shard = shard or min(LARGE, max(SMALL, n // SHARDS))
    # The sample: the fingerprints with the smallest hash, bounded and the same every time.
    size = max(1024, min(SAMPLE, 64 * (n // shard + 1)))
    sample = [r.fp for r in different.orderBy(F.xxhash64("fp"), "fp").limit(size).collect()] if n > shard else []
    words = np.array(sorted(sample), np.int64).view(np.uint64)
    tree = VPTree(words, max(1, len(words) * shard // max(n, 1)) if len(words) else 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            q = fp.view(np.uint64)
            home = np.full(len(q), -1)
            for leaf, _, at in tree.visit(q, 0):
                home[at] = leaf
            for leaf, _, at in tree.visit(q, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), leaf)), pa.array(fp[at]), pa.array(home[at] == leaf)], names=["shard", "fp", "home"])

    def join(t: pa.Table) -> pa.Table:
        fp = t["fp"].to_numpy()
        order = np.argsort(fp.view(np.uint64), kind="stable")
        fp, home = fp[order], t["home"].to_numpy()[order]
        root = connect(fp.view(np.uint64), home, radius)
        away = root != np.arange(len(fp))
        return pa.table({"a": fp[away], "b": fp[root[away]]})

    return different.mapInArrow(deal, "shard bigint, fp bigint, home boolean").groupBy("shard").applyInArrow(join, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """Large-star / small-star: (a, b) for every node a but the smallest (signed) node b
    of its component. Rounds are few, as shards have already made stars; each is
    checkpointed and the driver sees two numbers of it."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)), F.count_distinct("a")).first()
        # Stars: every node has one link, and another round changed nothing.
        if now == before:
            return edges
        before = now


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs."""
    marked = cut(fingerprints(docs))
    different = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    stars = components(links(different.select("fp"), different.count(), radius))
    rooted = different.join(stars.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id. Rows that
    repeat a doc_id are one document and stay or go together; rows without doc_id stay."""
    gone = near_duplicates(docs, radius).where("doc_id <> component_id").select("doc_id").distinct()
    return without(docs, {"doc_id": F.col("doc_id").cast("bigint")}, cut(gone))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
