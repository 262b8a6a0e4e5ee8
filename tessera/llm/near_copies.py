"""Near copies of the pipeline: texts whose sets of five-word shingles have a Jaccard
similarity of ``LEAST`` at least are linked; of each component one document stays.

Shingles: A-Z lower-cased, words are runs of anything but ASCII white space (a text of
one to four words is one shingle), hashed by XXH64. Equal sets are one node.

Candidates: SimHash fingerprints of ``BANDS`` 64-bit words over the set (a bit is 1 if set in
over half of the hashes), searched by the vantage-point trees of ``simhash`` for pairs that
differ in at most ``REACH`` bits. At a similarity of exactly 0.8 a bit differs with a
probability of 0.152 (0.161 at most from 5 shingles on, 0.188 for 4 against 5; computed for
all sizes under 60), so by the binomial formula under 1e-6 of such pairs are missed, 1e-4 of
those of 4 against 5 shingles; of unlike pairs 1e-11 are candidates. 64 bits cannot part
the two: there pairs differ in up to 14 bits or more, unlike texts in 32 +- 4.

The metric of the trees is the greater of the bits that differ and of the difference of
the logarithms of the sets' sizes, scaled so that ``RADIUS`` is a ratio of 1.25, beyond which
no pair is alike. By the triangle inequality a point visits every leaf with a point within
the radius; sizes let the trees leave out much, bits hardly anything, as unlike texts are
about equally far from each other. So comparisons are a share of all pairs of different texts,
the square of the input in the end (two words, xor and popcount, each). A pair meets in one
leaf only: that of the two with the higher number. A leaf's points are held by one task, those
that visit it stream past. Leaves give back a spanning forest of candidates, never pairs.

Linking: in each component of candidates (a bucket) all sets are verified against that of its
smallest node. Buckets that these links leave in several components are then verified
whole, but pairs of them are no rows: the sets of a bucket go to one task in blocks of some
``BLOCK`` bytes (those of the largest component apart, as its members need not meet each
other), which gives back links alone and leaves out pairs that are no candidates or are
linked by then. So a group of near copies costs its size in rows, and candidates without
being linked cost pairs in one task's memory only, two blocks at a time. A candidate alone
links nothing.

Plan: one scan of the texts (fingerprints are checkpointed), a shuffle of fingerprints by leaf,
the star rounds of ``simhash.components`` over candidates, one join that fetches the texts of
candidates, joins of pairs with their sets, the star rounds again over links; rows go by
the list of doc_ids to drop. The driver holds the sample of the top tree.

Defined results: null, empty and blank texts have the empty set and are one node; rows
that repeat a doc_id stay or go together; rows without doc_id stay; a very long text is
hashed as a whole, 8 bytes a shingle; empty table = no rows; extra columns, whatever
their names, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, only, slices, text_of, without
from .simhash import LARGE, SAMPLE, SHARDS, SMALL, Forest, VPTree, components

WORDS, LEAST = 5, (4, 5)
#: Bytes of sets in a block; longer sets are blocks of their own.
BLOCK = 1 << 22
#: 64-bit words of a fingerprint, bits that may differ in all and in the first two words.
BANDS, RADIUS, FIRST = 4, 72, 48
#: Points in a leaf of a shard's tree, and those that are compared with a leaf at a time.
LEAF, PART = 256, 1024
SEED = 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The ascending different hashes of a text's shingles."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.array(sorted({digest(join(w[i : i + WORDS]), SEED) for i in range(max(1, len(w) - WORDS + 1))}) if w else [], np.uint64)


def node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The words of a set's fingerprint; zero for the empty set."""
    ones, half = np.zeros(BANDS * 64, np.int64), np.uint64(32)
    for lo in range(0, len(hashes), 255):
        x = hashes[lo : lo + 255, None] * _FACTORS[0]
        x = (x ^ (x >> half)) * _FACTORS[1]
        x ^= x >> half
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes)).view(np.uint64)


def points(fps: pa.Array, sizes: pa.Array) -> np.ndarray:
    """Rows of the words and of the size's scaled logarithm."""
    words = np.frombuffer(b"".join(fps.to_pylist()), np.uint64).reshape(-1, BANDS)
    scaled = np.rint(np.log(sizes.to_numpy()) * (RADIUS / np.log(LEAST[1] / LEAST[0])))
    return np.column_stack([words, scaled.astype(np.uint64)])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    bits = np.bitwise_count(a[..., :BANDS] ^ b[..., :BANDS]).sum(-1, dtype=np.int64)
    return np.maximum(bits, np.abs(a[..., BANDS].astype(np.int64) - b[..., BANDS].astype(np.int64)))


#: Two sizes within the ratio differ by one more at most once they are rounded.
REACH = RADIUS + 1


def candidates(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a and b of the pairs within reach."""
    bits = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    bits += np.bitwise_count(a[:, None, 1] ^ b[None, :, 1])
    i, j = np.nonzero(bits <= FIRST)
    near = distance(a[i], b[j]) <= REACH
    return i[near], j[near]


class Shard:
    """The points of one leaf of the top tree, in a tree of their own."""

    def __init__(self, names: np.ndarray, rows: np.ndarray):
        order = np.argsort(rows[:, BANDS], kind="stable")
        self.names, self.rows, self.forest = names[order], rows[order], Forest(len(names))
        self.tree = VPTree(self.rows, LEAF, distance)

    def meet(self, rows: np.ndarray, home: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions in rows and here of candidates; a leaf does not meet rows at home in later ones."""
        for leaf, at, q in self.tree.visit(rows, REACH):
            q = q if home is None else q[home[q] <= leaf]
            for lo in range(0, len(q), PART):
                i, j = candidates(rows[q[lo : lo + PART]], self.rows[at])
                if len(i):
                    yield q[lo + i], at[j]

    def own(self) -> pa.RecordBatch:
        home = np.zeros(len(self.names), np.int64)
        for leaf, _, at in self.tree.visit(self.rows, 0):
            home[at] = leaf
        for i, j in self.meet(self.rows, home):
            self.forest.union(i, j)
        root = self.forest.roots()
        away = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(self.names[away]), pa.array(self.names[root[away]])], names=["a", "b"])

    def visitors(self, names: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        root = self.forest.roots()
        for i, j in self.meet(rows):
            found = np.unique(np.column_stack([names[i], self.names[root[j]]]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def near_points(different: DataFrame, shard: int | None = None) -> DataFrame:
    """different: node, size, fp without repeats. Links (a, b) that connect all candidates."""
    different = different.where("size > 0").select("node", "size", "fp")
    n = different.count()
    shard = shard or min(LARGE, max(SMALL, n // SHARDS))
    size = max(1024, min(SAMPLE, 64 * (n // shard + 1)))
    sample = different.orderBy(F.xxhash64("node"), "node").limit(size).toArrow() if n > shard else different.limit(0).toArrow()
    rows = points(sample["fp"], sample["size"])
    rows = rows[np.argsort(rows[:, BANDS], kind="stable")]
    tree = VPTree(rows, max(1, len(rows) * shard // max(n, 1)), distance)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            rows = points(b.column(2), b.column(1))
            home = np.full(len(rows), -1)
            for leaf, _, at in tree.visit(rows, 0):
                home[at] = leaf
            for leaf, _, at in tree.visit(rows, REACH):
                at = at[home[at] <= leaf]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), leaf, np.int32)), pa.array(home[at] < leaf), *(c.take(pa.array(at)) for c in b.columns)], names=["shard", "visits", *b.schema.names])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for b in slices(batches, 4096):
            shards, visits, names = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
            rows = points(b.column(4), b.column(3))
            ends = [*(np.flatnonzero((np.diff(shards) != 0) | (np.diff(visits.astype(int)) != 0)) + 1).tolist(), len(rows)]
            for lo, hi in zip([0, *ends], ends, strict=False):
                if shards[lo] != now:
                    if held and index is None:
                        yield _index(held).own()
                    now, held, index = shards[lo], [], None
                if not visits[lo]:
                    held.append((names[lo:hi], rows[lo:hi]))
                elif held:
                    if index is None:
                        index = _index(held)
                        yield index.own()
                    yield from index.visitors(names[lo:hi], rows[lo:hi])
        if held and index is None:
            yield _index(held).own()

    dealt = different.mapInArrow(deal, "shard int, visits boolean, node bigint, size bigint, fp binary")
    dealt = dealt.repartitionById(max(1, tree.leaves), F.col("shard")).sortWithinPartitions("shard", "visits")
    return dealt.mapInArrow(join, "a bigint, b bigint")


def _index(held: list) -> Shard:
    names, rows = zip(*held, strict=True)
    return Shard(np.concatenate(names), np.concatenate(rows))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST[1] >= (len(a) + len(b) - both) * LEAST[0]


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, node, size of its set and fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [(node(h), len(h), fingerprint(h).tobytes()) for h in map(shingles, b.column(1).to_pylist())]
            n, size, fps = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(fps, pa.binary())], names=["doc_id", "node", "size", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id bigint, node bigint, size bigint, fp binary")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and hashes of the wanted (doc_id, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [shingles(t) for t in b.column(0).to_pylist()]
            columns = [pa.array(list(map(node, found)), pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "hashes"])

    named = F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit(""))
    ids = cut(wanted.select(named.alias("id")).distinct())
    texts = only(docs.select("doc_id", text_of().alias("text")), {"id": named}, ids).select("text")
    return texts.mapInArrow(run, "node bigint, hashes binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices(batches):
            x, y = ([np.frombuffer(h, np.uint64) for h in t.column(c).to_pylist()] for c in (2, 3))
            yield t.select([0, 1]).filter(pa.array([alike(p, q) for p, q in zip(x, y, strict=True)], pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _fits(a: str, b: str):
    """Whether two sizes allow the similarity."""
    return F.least(a, b) * LEAST[1] >= F.greatest(a, b) * LEAST[0]


def _rooted(df: DataFrame, stars: DataFrame) -> DataFrame:
    return df.join(stars.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_links(docs: DataFrame, different: DataFrame, shard: int | None = None) -> DataFrame:
    """different: doc_id, node, size, fp without repeats. Links (a, b) of alike nodes
    that connect all alike candidates."""
    stars = components(near_points(different, shard))
    rows = stars.select(F.col("a").alias("node"), F.col("b").alias("key")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("key")).distinct())
    rows = rows.join(different.select("node", "size"), "node")
    first = rows.groupBy("key").agg(F.min(F.struct("node", "size")).alias("s"))
    rows = cut(rows.join(first, "key").select("key", "node", "size", F.col("s.node").alias("b"), F.col("s.size").alias("other")))
    pairs = cut(rows.where("node <> b").where(_fits("size", "other")).select(F.col("node").alias("a"), "b"))
    sets = cut(_sets(docs, different.join(rows.select("node"), "node", "left_semi")))
    links = cut(_verified(pairs, sets))
    rows = _rooted(rows.select("key", "node", "size"), components(links))
    mixed = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    rows = cut(rows.join(mixed, "key", "left_semi"))
    # Blocks of a bucket: those of its largest component first, then those of the others.
    parts = rows.groupBy("key", "root").agg(F.sum("size").alias("bytes"))
    parts = parts.groupBy("key").agg(F.max(F.struct("bytes", "root")).alias("m"), F.sum("bytes").alias("bytes"))
    blocks = lambda x: F.ceil(x * 8 / F.lit(BLOCK)).cast("int")
    parts = parts.select("key", F.col("m.root").alias("main"), blocks(F.col("m.bytes")).alias("n_main"), blocks(F.col("bytes") - F.col("m.bytes")).alias("n_rest"))
    dealt = rows.join(parts, "key")
    is_main, h = F.col("root") == F.col("main"), F.xxhash64("node")
    own = F.when(is_main, F.pmod(h, F.col("n_main"))).otherwise(F.col("n_main") + F.pmod(h, F.col("n_rest"))).cast("int")
    rest = F.sequence(F.col("n_main"), F.col("n_main") + F.col("n_rest") - 1)
    meets = F.when(is_main, rest).otherwise(F.sequence(F.lit(0), F.col("n_main") + F.col("n_rest") - 1))
    dealt = dealt.withColumn("own", own).select("key", "node", "root", "own", F.explode(meets).alias("far"))
    dealt = dealt.select("key", "node", "root", "own", F.least("own", "far").alias("p"), F.greatest("own", "far").alias("q"))
    more = dealt.join(sets, "node").withColumn("keys", F.array("key")).groupBy("key", "p", "q").applyInArrow(_bucket_links, "a bigint, b bigint")
    return links.unionByName(more)


def _bucket_links(t: pa.Table) -> pa.Table:
    """Links between the sets of two blocks (or of one) of a bucket that are alike, not yet
    linked and share no earlier key (of ``keys``, the buckets of a set): a spanning forest of
    them. Of sets whose fingerprints are out of reach none are alike."""
    order = np.argsort(t["node"].to_numpy(), kind="stable")
    t = t.take(pa.array(order))
    names, block = t["node"].to_numpy(), t["own"].to_numpy()
    across = t["p"][0].as_py() != t["q"][0].as_py()
    key, forest = t["key"][0].as_py(), np.unique(t["root"].to_numpy(), return_inverse=True)[1]
    ks = np.array(t["keys"].to_pylist(), np.int64).reshape(len(names), -1)
    band = int(np.flatnonzero(ks[0] == key)[0])
    sets = [np.frombuffer(h, np.uint64) for h in t["hashes"].to_pylist()]
    fps = np.array([fingerprint(x) for x in sets])
    n = np.array([len(x) for x in sets], np.int64)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.r_[0, np.cumsum(n)]
    mark = np.zeros(int(codes.max(initial=-1)) + 1, bool)
    a, b = [], []
    for i in range(len(names) - 1):
        j = np.arange(i + 1, len(names))
        j = j[forest[j] != forest[i]]
        if across:
            j = j[block[j] != block[i]]
        j = j[np.minimum(n[j], n[i]) * LEAST[1] >= np.maximum(n[j], n[i]) * LEAST[0]]
        j = j[np.bitwise_count(fps[j] ^ fps[i]).sum(1) <= REACH]
        j = j[~(ks[j, :band] == ks[i, :band]).any(1)]
        if not len(j):
            continue
        mark[codes[start[i] : start[i + 1]]] = True
        at = np.repeat(start[j] - (np.cumsum(n[j]) - n[j]), n[j]) + np.arange(int(n[j].sum()))
        both = np.add.reduceat(mark[codes[at]].astype(np.int64), np.cumsum(n[j]) - n[j])
        mark[codes[start[i] : start[i + 1]]] = False
        for k in j[both * LEAST[1] >= (n[j] + n[i] - both) * LEAST[0]].tolist():
            if forest[k] != forest[i]:
                a.append(names[k])
                b.append(names[i])
                forest[forest == forest[k]] = forest[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def drop_near(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: that with the smallest doc_id."""
    marked = cut(_marked(docs))
    different = cut(marked.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("fp").alias("fp")))
    rooted = _rooted(different.select("node", "doc_id"), components(near_links(docs, different)))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.select("node", "root").join(least, "root").select("node", "component_id")
    gone = marked.select("doc_id", "node").join(named, "node").where("doc_id <> component_id").select("doc_id").distinct()
    return without(docs, {"doc_id": F.col("doc_id").cast("bigint")}, cut(gone))
