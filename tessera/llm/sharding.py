"""Reproducible shuffle and sharding by a Feistel permutation with cycle walking.

Rows are numbered 0..n-1 in the order of (doc_id, size, crc32). A keyed Feistel
network permutes the smallest even-or-odd bit domain that holds n; positions that
fall outside are sent through again until they fall inside (cycle walking), so the
result is a permutation of 0..n-1. Position p goes to shard ``p mod shards``, slot
``p // shards``: counts of shards differ by one at most, slots are gapless, and
:func:`place` and :func:`row_at` compute either way without any data.

Plan: only doc_id, size and CRC of a row are sorted (range partitions, one
shuffle, no text); the sorted rows are checkpointed, so that the numbering cannot
change between the count of each partition and its use; the driver holds one
count per partition; the permutation is vectorised arithmetic on Arrow batches.

Defined results: null text has size 16 and CRC 0; null doc_id sorts first; equal
rows get different slots; a very long text is read for its size and CRC alone; an empty
table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_of

ROUNDS = 6
SEED = 20_250_101
SHARDS = 40


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser of multiplications and shifts."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def _keys(seed: int) -> list[int]:
    return [int(k) for k in _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64), seed)]


def _halves(n: int) -> tuple[int, int]:
    bits = max(2, (max(n, 2) - 1).bit_length())
    return bits // 2, bits - bits // 2


def _feistel(x: np.ndarray, lo: int, hi: int, keys: list[int], back: bool) -> np.ndarray:
    """Each round adds, by XOR, a function of one half to the other, in turns."""
    low = np.uint64((1 << lo) - 1)
    high = np.uint64((1 << hi) - 1)
    b, a = x & low, x >> np.uint64(lo)
    steps = list(enumerate(keys))
    for i, k in reversed(steps) if back else steps:
        if i % 2:
            b = b ^ (_mix(a, k) & low)
        else:
            a = a ^ (_mix(b, k) & high)
    return (a << np.uint64(lo)) | b


def permute(rows: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 (or its inverse) at the given places."""
    (lo, hi), keys = _halves(n), _keys(seed)
    x = _feistel(np.asarray(rows, np.uint64), lo, hi, keys, back)
    while (out := x >= np.uint64(n)).any():
        x[out] = _feistel(x[out], lo, hi, keys, back)
    return x.astype(np.int64)


def place(rows: np.ndarray, n: int, shards: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of global row numbers."""
    p = permute(rows, n, seed)
    return p % shards, p // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int = SEED) -> np.ndarray:
    """The global row number that is at a shard's slot."""
    return permute(np.asarray(slot, np.int64) * shards + shard, n, seed, back=True)


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null)."""
    text = F.encode(text_of(), "utf-8")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.length(text) + F.lit(16)).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    order = ["doc_id", "size", "text_crc32"]
    ordered = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    counts = {r[0]: r[1] for r in ordered.groupBy(F.spark_partition_id()).count().collect()}  # one number a partition
    n, before, total = sum(counts.values()), {}, 0
    for k in sorted(counts):
        before[k], total = total, total + counts[k]

    def number(batches):
        at = before.get(TaskContext.get().partitionId(), 0)
        for b in batches:
            shard, slot = place(np.arange(at, at + b.num_rows), n, shards, seed)
            at += b.num_rows
            more = [pa.array(["rows"] * b.num_rows), pa.array(shard.astype(np.int32)), pa.array(slot), pa.nulls(b.num_rows, pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*order, "law", "shard", "slot", "grown_shard"])

    return ordered.mapInArrow(number, "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int")


def op3_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
