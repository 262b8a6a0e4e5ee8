"""Exact dedup with a cuckoo-filter index.

Texts are equal when they are identical after each run of ASCII white space is
replaced by one space (the ends are not trimmed); null counts as the empty text.
Digests are SHA-256 of the normalised text, made by Spark functions.

Each partition keeps a :class:`CuckooIndex`: buckets of four slots, each with a 16-bit
tag and the stored key and value behind it; a key may be in two buckets, given by its
hash and its tag. Where no tag of the two fits, a digest is new; where one fits, it is
verified against the key stored there, so equal tags never merge two texts. An insertion
that finds no free slot moves others to their second bucket; after ``MAX_KICKS`` moves
the index is built anew at twice the size from the stored keys. When an index holds
``max_live`` digests it passes on the oldest ones and deletes them, so the memory of
a task has a bound.

Plan: digests are made once and checkpointed (no text is read twice); the index
first works on each input partition, so a group of copies of any size leaves a
partition as one row (the pre-aggregation before the shuffle); the partial rows
are dealt and sorted by digest and merged by a second index, whose oldest digests are
complete when they are passed on; then each document is joined to its group, which
AQE splits where a digest is hot. ``drop_copies`` joins keys alone, and drops rows
by the list of those that go.

Defined results: null text = empty text; empty table = no rows; repeated rows
(same doc_id and text) all point to that doc_id and count in ``group_size``; a
null doc_id never stays unless its group has no other; a very long text is hashed by
Spark's functions as a whole; extra columns, whatever their names, are ignored, by
``drop_copies`` kept.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, table, text_of, without

SLOTS = 4
MAX_KICKS = 200
MAX_LIVE = 500_000


class CuckooIndex:
    """Live keys (32 random bytes) with a value each, in buckets by partial-key cuckoo
    hashing: a slot's other bucket follows from its bucket and tag alone."""

    def __init__(self, buckets: int = 1024):
        assert buckets & (buckets - 1) == 0, "the number of buckets is a power of two"
        self.resizes = self.size = self._turn = 0
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.tags = [0] * (buckets * SLOTS)
        self.keys: list[bytes | None] = [None] * (buckets * SLOTS)
        self.values: list = [None] * (buckets * SLOTS)
        self.size = 0

    def __len__(self) -> int:
        return self.size

    @staticmethod
    def tag(key: bytes) -> int:
        return int.from_bytes(key[8:10], "little") or 1

    def places(self, key: bytes) -> tuple[int, int, int]:
        t = self.tag(key)
        i = int.from_bytes(key[:8], "little") & self.mask
        return t, i, self.other(i, t)

    def other(self, bucket: int, tag: int) -> int:
        return (bucket ^ (tag * 0x5BD1E995)) & self.mask

    def _slot(self, key: bytes) -> int:
        """The slot that holds the key, or -1."""
        t, i, j = self.places(key)
        for b in (i, j):
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.tags[s] == t and self.keys[s] == key:
                    return s
        return -1

    def _free(self, bucket: int) -> int:
        for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.tags[s]:
                return s
        return -1

    def _fill(self, slot: int, tag: int, key: bytes, value: list) -> None:
        self.tags[slot], self.keys[slot], self.values[slot] = tag, key, value

    def get(self, key: bytes) -> list | None:
        s = self._slot(key)
        return None if s < 0 else self.values[s]

    def put(self, key: bytes, value: list) -> None:
        """Adds a key that is not there."""
        while not self._insert(key, value):
            self._grow()

    def _insert(self, key: bytes, value: list) -> bool:
        """False if no slot was found; the index is then as it was before."""
        t, i, j = self.places(key)
        for b in (i, j):
            if (s := self._free(b)) >= 0:
                self._fill(s, t, key, value)
                self.size += 1
                return True
        moved: list[tuple] = []
        b, put = i, (t, key, value)
        for _ in range(MAX_KICKS):
            self._turn = (self._turn * 5 + 1) & 0xFFFF
            s = b * SLOTS + self._turn % SLOTS
            old = self.tags[s], self.keys[s], self.values[s]
            moved.append((s, *old))
            self._fill(s, *put)
            put, b = old, self.other(b, old[0])
            if (f := self._free(b)) >= 0:
                self._fill(f, *put)
                self.size += 1
                return True
        for s, *old in reversed(moved):
            self._fill(s, *old)
        return False

    def remove(self, key: bytes) -> list | None:
        s = self._slot(key)
        if s < 0:
            return None
        value = self.values[s]
        self._fill(s, 0, None, None)
        self.size -= 1
        return value

    def items(self) -> list[tuple[bytes, list]]:
        return [(k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None]

    def _grow(self) -> None:
        held, buckets = self.items(), (self.mask + 1) * 2
        while True:
            self._empty(buckets)
            self.resizes += 1
            if all(self._insert(k, v) for k, v in held):
                return
            buckets *= 2


PARTIAL = "digest binary, keep_id bigint, group_size bigint, at_min bigint"


def _merge(value: list, keep: int | None, n: int, at_min: int) -> None:
    """value: smallest doc_id, rows, rows with that doc_id."""
    if value[0] == keep:
        value[2] += at_min
    elif value[0] is None or (keep is not None and keep < value[0]):
        value[0], value[2] = keep, at_min
    value[1] += n


def _rows(items: list[tuple[bytes, list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k for k, _ in items], pa.binary()),
            pa.array([v[0] for _, v in items], pa.int64()),
            pa.array([v[1] for _, v in items], pa.int64()),
            pa.array([v[2] for _, v in items], pa.int64()),
        ],
        names=["digest", "keep_id", "group_size", "at_min"],
    )


def index_groups(max_live: int):
    """An Arrow map that sends rows (digest, keep_id, group_size, at_min) through a
    cuckoo index. A full index passes its older half on; of sorted rows these are complete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, came = CuckooIndex(), deque()
        for b in batches:
            for key, keep, n, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                value = index.get(key)
                if value is None:
                    index.put(key, [keep, n, at])
                    came.append(key)
                else:
                    _merge(value, keep, n, at)
                if len(index) > max_live:
                    old = [came.popleft() for _ in range(len(came) // 2)]
                    yield _rows([(k, index.remove(k)) for k in old])
        items = index.items()
        for i in range(0, len(items), 20_000):
            yield _rows(items[i : i + 20_000])

    return run


def _digest() -> Column:
    return F.unhex(F.sha2(F.regexp_replace(text_of(), SPACE, " "), 256))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the normalised text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _digest().alias("digest"))


def groups(digested: DataFrame, max_live: int = MAX_LIVE) -> DataFrame:
    """One row per different digest: digest, keep_id, group_size, at_min."""
    one = F.lit(1).cast("bigint")
    rows = digested.select("digest", F.col("doc_id").alias("keep_id"), one.alias("group_size"), one.alias("at_min"))
    partial = rows.mapInArrow(index_groups(max_live), PARTIAL)
    return partial.repartition("digest").sortWithinPartitions("digest").mapInArrow(index_groups(max_live), PARTIAL)


def dedup(docs: DataFrame) -> DataFrame:
    """Every row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    marked = cut(digests(docs))
    return marked.join(groups(marked), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, max_live: int = MAX_LIVE) -> DataFrame:
    """docs without copies: of equal texts the row with the smallest doc_id, once. A row is
    known by its doc_id and the XXH64 of its text as it is; of rows with one doc_id and
    equal texts the one with the smallest hash stays, of rows that are alike in both one."""
    key = {"id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text": F.xxhash64(text_of())}
    marked = cut(docs.select(*[x.alias(k) for k, x in key.items()], F.col("doc_id").cast("bigint").alias("doc_id"), _digest().alias("digest")))
    found = groups(marked.select("doc_id", "digest"), max_live).select("digest", "keep_id", "at_min")
    rows = cut(marked.join(found, "digest").where(~F.col("doc_id").eqNullSafe(F.col("keep_id")) | (F.col("at_min") > 1)).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("keep_id"))))
    # Rows that repeat a doc_id with its text are few; only they are dealt out once more.
    first = rows.where("stays").groupBy("digest").agg(F.min("text").alias("least"))
    again = cut(rows.where("stays").join(first, "digest").groupBy(*key).agg(F.max(F.col("text") == F.col("least")).alias("least"), F.count("*").alias("n")))
    gone = rows.where("NOT stays").select(*key).unionByName(again.where("n > 1 OR NOT least").select(*key)).distinct()
    once = without(docs, key, gone)
    repeated = again.where("n > 1 AND least").select(*key)
    if repeated.isEmpty():
        return once
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[x.alias(k) for k, x in key.items()])
    one = inner.join(repeated, list(key), "left_semi").dropDuplicates(list(key))
    return once.unionByName(one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
