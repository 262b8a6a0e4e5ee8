"""Exact top-k search: BM25 over an inverted index with block-max WAND pruning, per shard.

Words are lower-cased runs of letters, digits and underscore, kept as 64-bit hashes.
A shard indexes documents of a partition until it has ``POSTINGS`` postings: for each
term the places of its documents and the counts. Statistics are global (number of
documents, those without words included, mean length, document frequencies over all
shards), so scores of different shards compare and the merge of their top k is exact.

In a shard alike documents are side by side, in blocks of ``BLOCK`` and tiles of ``TILE``
documents. Lists of terms in over 1 / ``DENSE`` of the documents have their largest
impact in each block; in the shorter lists a block would hold about one posting or none,
so the postings are the maxima. WAND's test, whether the maxima of the terms that are
there could reach the k-th best score so far (the threshold), is made for all blocks of
a query at once: short lists are added up, block maxima of the others give a bound for
each block. Tiles are visited from the highest bound down while the threshold rises,
until no bound reaches it. In a tile blocks below the threshold are skipped, unless most
reach it: then a pass over the whole tile is cheaper. Bounds are 32-bit floats with a
margin above their rounding; documents that reach the threshold are scored in 64 bits
from their own postings. Scores are rounded to 9 decimals, ties go to the smaller doc_id.

Plan: documents are tokenised once into index rows in the shared folder; document
frequencies are summed by term; queries get their weights by a join on the term (AQE
splits hot terms) and equal queries become one, so a group of copies asks once. Blocks
of queries (``PAIRS`` term weights, 16 bytes each) are broadcast in turn to all shards,
which write their top k; these are merged by query. Memory: one shard and one block
of queries in a task, one block in the driver. Work grows as queries times blocks.

Defined results: null or empty texts and texts without words are found by nobody and
ask nothing, but count as documents; a null doc_id is found as null, before any other
of equal score, and asks nothing; rows that repeat a doc_id ask once for each different
text (``query_key`` tells them apart) and are found each; the asking document is among
the hits; a very long text is one document of a shard like any other; empty table = no
rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, remove, scratch, table, text_of

K1, B, TOP = 1.2, 0.75, 10
POSTINGS, BLOCK, TILE, DENSE = 4_000_000, 8, 1024, 16
#: A tile with a smaller share of its blocks to score is scored block by block.
FEW = 0.08
#: Above the rounding of bounds, as a share and in all.
MARGIN = 1e-5
NO_ID = -(1 << 63)
#: (term, weight) pairs of the queries that are broadcast at once: 16 bytes each.
PAIRS = 4_000_000
_WORD = re.compile(r"\w+")

INDEX = "docs bigint, length bigint, doc_ids binary, lengths binary, terms binary, sizes binary, places binary, counts binary"
HITS = "query bigint, doc_id bigint, score double"


def words(text: str) -> Counter:
    """Term (signed 64-bit hash) -> count."""
    return Counter({xxhash.xxh64_intdigest(w) - (1 << 63): n for w, n in Counter(_WORD.findall(text.lower())).items()})


def _index(docs: int, doc_ids: list, texts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """docs: documents seen, doc_ids and texts of those with words."""
    n = [len(t) for t, _ in texts]
    term, count = (np.concatenate([x[i] for x in texts]) if texts else np.zeros(0, t) for i, t in ((0, np.int64), (1, np.int32)))
    place = np.repeat(np.arange(len(texts), dtype=np.int32), n)
    order = np.argsort(term, kind="stable")
    terms, sizes = np.unique(term, return_counts=True)
    lengths = np.array([c.sum(dtype=np.int64) for _, c in texts], np.int64)
    row = [docs, int(lengths.sum()), np.array(doc_ids, np.int64), lengths, terms, sizes.astype(np.int32), place[order], count[order]]
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes() if isinstance(v, np.ndarray) else v], k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])


def write_index(docs: DataFrame, path: str, postings: int = POSTINGS) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, ids, texts = 0, 0, [], []
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                seen += 1
                if t := words(text.as_py()):
                    ids.append(doc_id.as_py())
                    # 12 bytes a word; as a Counter the documents of a shard took a tenfold.
                    texts.append((np.fromiter(t, np.int64, len(t)), np.fromiter(t.values(), np.int32, len(t))))
                    held += len(t)
                if held >= postings:
                    yield _index(seen, ids, texts)
                    seen, held, ids, texts = 0, 0, [], []
        if seen:
            yield _index(seen, ids, texts)

    ids = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id")
    docs.select(ids, text_of().alias("text")).mapInArrow(run, INDEX).write.parquet(path)


class Shard:
    """The postings of a shard by term and by document, with impacts and block maxima,
    for given statistics. ``scored`` counts the documents that were scored.

    Terms of more than 1 / DENSE of the documents also have their impacts as a row over
    all documents; the rows are at most DENSE times the postings."""

    def __init__(self, row: dict, mean: float, block: int = BLOCK, tile: int = TILE):
        get = lambda k, t: np.frombuffer(row[k], t)
        self.ids, lengths = get("doc_ids", np.int64), get("lengths", np.int64)
        self.terms, sizes = get("terms", np.int64), get("sizes", np.int32)
        place, count = get("places", np.int32), get("counts", np.int32).astype(float)
        self.impact = count * (K1 + 1) / (count + K1 * (1 - B + B * lengths[place] / mean))
        self.first = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
        n = len(self.ids)
        self.block, self.tile, self.tiles, self.scored = block, tile, -(-n // tile), 0
        dense = np.flatnonzero(sizes * DENSE > n)
        self.row = np.full(len(self.terms), -1, np.int64)
        self.row[dense] = np.arange(len(dense))
        # Alike documents come into the same blocks: by strongest common term, then length.
        best, strongest = np.zeros(n, np.float32), np.full(n, -1, np.int32)
        for i, t in enumerate(dense):
            at = slice(self.first[t], self.first[t + 1])
            better = self.impact[at] > best[place[at]]
            p = place[at][better]
            best[p], strongest[p] = self.impact[at][better], i
        order = np.lexsort((lengths, strongest))
        new = np.empty(n, np.int32)
        new[order] = np.arange(n)
        self.ids, self.places = self.ids[order], new[place]
        wide = np.zeros((self.tiles, len(dense), tile), np.float32)
        for i, t in enumerate(dense):
            p = self.places[self.first[t] : self.first[t + 1]]
            wide[p // tile, i, p % tile] = self.impact[self.first[t] : self.first[t + 1]]
        self.wide = wide
        self.most = np.ascontiguousarray(wide.reshape(self.tiles, len(dense), tile // block, block).max(axis=3).transpose(1, 0, 2)).reshape(len(dense), -1)
        # The same postings by document, for exact scores: terms ascending in each.
        by_doc = np.argsort(self.places, kind="stable")
        self.doc_term = np.repeat(np.arange(len(self.terms), dtype=np.int32), sizes)[by_doc]
        self.doc_impact = self.impact[by_doc]
        self.doc_first = np.r_[0, np.cumsum(np.bincount(self.places, minlength=n))]
        self.weight = np.zeros(len(self.terms))

    @staticmethod
    def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a[0]..b[0]-1, a[1]..b[1]-1, .. in one array."""
        n = b - a
        return np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))

    def search(self, terms: np.ndarray, weights: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """doc_ids and scores of the best documents; terms ascending."""
        nothing = np.zeros(0, np.int64), np.zeros(0)
        if not len(self.terms):
            return nothing
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        here = self.terms[at] == terms
        at, weights = at[here], weights[here]
        if not len(at):
            return nothing
        row, per = self.row[at], self.tile // self.block
        rare, rows, w = row < 0, row[row >= 0], weights[row >= 0].astype(np.float32)
        a, b = self.first[at[rare]], self.first[at[rare] + 1]
        post = self._ranges(a, b)
        sure = np.bincount(self.places[post], np.repeat(weights[rare], b - a) * self.impact[post], self.tiles * self.tile)
        bound = np.maximum.reduce([sure[i :: self.block] for i in range(self.block)]) + w @ self.most[rows]
        bound = (bound * (1 + MARGIN) + MARGIN * (bound > 0)).reshape(self.tiles, per)
        sure = sure.reshape(self.tiles, self.tile)

        where, held, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        best = bound.max(axis=1)
        for t in np.argsort(-best).tolist():
            if best[t] < max(least, 1e-12):
                break
            reach = np.flatnonzero(bound[t] >= least)
            if len(reach) < FEW * per:
                some = (reach[:, None] * self.block + np.arange(self.block)).ravel()
                got = sure[t, some] + w @ self.wide[t][rows[:, None], some]
            else:
                some = np.arange(self.tile)
                got = sure[t] + w @ self.wide[t][rows]
            self.scored += len(some)
            keep = np.flatnonzero(got >= max(1e-12, least - MARGIN * (1 + least)))
            if not len(keep):
                continue
            where, held = np.r_[where, t * self.tile + some[keep]], np.r_[held, got[keep]]
            if len(held) >= top:
                least = max(least, float(np.partition(held, -top)[-top]))
                stay = held >= least - MARGIN * (1 + least)
                where, held = where[stay], held[stay]
        some = np.sort(where)
        # Exact scores of what reaches the threshold, from the documents' own postings.
        self.weight[at] = weights
        a, b = self.doc_first[some], self.doc_first[some + 1]
        own = self._ranges(a, b)
        exact = np.bincount(np.repeat(np.arange(len(some)), b - a), self.weight[self.doc_term[own]] * self.doc_impact[own], len(some))
        self.weight[at] = 0.0
        exact, ids = np.round(exact, 9), self.ids[some]
        best = np.lexsort((ids, -exact))[:top]
        best = best[exact[best] > 0]
        return ids[best], exact[best]


def search(docs: DataFrame, asking: DataFrame, top: int = TOP, postings: int = POSTINGS, pairs: int = PAIRS) -> DataFrame:
    """query_id, query_key, rank, doc_id, score: the top documents of docs for each
    different row of asking (doc_id, text)."""
    spark = docs.sparkSession
    path = scratch(spark, "bm25")
    write_index(docs, path, postings)
    index = spark.read.schema(INDEX).parquet(path)
    docs_, length = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()

    def frequencies(batches):
        for b in batches:
            for terms, sizes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int64)), pa.array(np.frombuffer(sizes, np.int32).astype(np.int64))], names=["term", "n"])

    def ask(batches):
        for b in batches:
            for q, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t := words(text):
                    keys = sorted(t)
                    same = xxhash.xxh64_intdigest(np.array([x for k in keys for x in (k, t[k])], np.int64).tobytes()) - (1 << 63)
                    yield pa.RecordBatch.from_arrays([pa.array([q] * len(t), pa.int64()), pa.array([same] * len(t), pa.int64()), pa.array(keys, pa.int64()), pa.array([t[k] for k in keys], pa.int64())], names=["query_id", "query", "term", "n"])

    rows = asking.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("query_id"), text_of().alias("text"))
    asked = cut(rows.mapInArrow(ask, "query_id bigint, query bigint, term bigint, n bigint"))
    members = asked.select("query_id", "query").distinct()
    different = asked.join(members.groupBy("query").agg(F.min("query_id").alias("query_id")), ["query", "query_id"]).select("query", "term", "n").distinct()
    df = index.select("terms", "sizes").mapInArrow(frequencies, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.col("n") * F.log(1 + (F.lit(docs_) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = different.join(df, "term").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", weight.alias("w")))).alias("p"))
    def packed(batches):
        for b in batches:
            pairs_, at = b.column(1), np.r_[b.column(1).offsets.to_numpy()]
            terms, weights = (pairs_.values.field(i).to_numpy() for i in (0, 1))
            cells = [[x[i:j].tobytes() for i, j in zip(at, at[1:])] for x in (terms, weights)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.binary()) for c in cells]], names=["query", "terms", "weights"])

    # Queries are put into blocks of bounded size by their running number of pairs. The
    # driver holds one block at a time, 16 bytes a pair; its hits are written before the next.
    blobs = weighted.mapInArrow(packed, "query bigint, terms binary, weights binary")
    sized = cut(blobs.withColumn("part", F.pmod("query", F.lit(max(1, asked.count() // pairs * 2 + 1)))))
    found = scratch(spark, "bm25-hits")
    spark.createDataFrame([], HITS).write.parquet(found)
    for (part,) in sized.select("part").distinct().orderBy("part").collect():
        rows = sized.where(F.col("part") == part).select("query", "terms", "weights").toArrow().to_pylist()
        held = spark.sparkContext.broadcast([(r["query"], r["terms"], r["weights"]) for r in rows])

        def run(batches, held=held, mean=length / max(1, docs_)):
            for b in batches:
                for row in b.to_pylist():
                    s = Shard(row, mean)
                    out = [(q, *s.search(np.frombuffer(t, np.int64), np.frombuffer(w, np.float64), top)) for q, t, w in held.value]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([q for q, *_ in out], np.int64), [len(i) for _, i, _ in out])), pa.array(np.concatenate([i for _, i, _ in out])), pa.array(np.concatenate([x for *_, x in out]))], names=["query", "doc_id", "score"])

        index.mapInArrow(run, HITS).write.mode("append").parquet(found)
        held.destroy()
    remove(spark, path)
    hits = spark.read.schema(HITS).parquet(found)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    top_hits = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    found_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    return members.join(top_hits, "query").select("query_id", F.col("query").alias("query_key"), "rank", found_id, "score")


def op7_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 100 asks all documents."""
    docs = table(spark, sf_dir, "documents")
    return search(docs, docs.where("doc_id % 100 = 0"))
