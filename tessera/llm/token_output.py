"""Token ids in binary files, compressed by a Re-Pair grammar per shard.

Documents are range-partitioned and sorted by doc_id, encoded (public byte-level
BPE, then id 2) and cut into shards of about ``SHARD_TOKENS`` ids, whole documents
each. Per shard, frequent adjacent pairs are repeatedly replaced by nonterminals (ids
from the vocabulary's size up); a pair never spans two documents. Pairs are counted
exactly, occurrences that overlap (in runs of one id) once. In a round all pairs that
occur ``least`` times or more are ranked by their counts, each occurrence that shares
no symbol with one of a better pair is replaced, and a pair that would be replaced in
fewer places waits. Rounds go on until no pair is so frequent; ``least`` falls over
``PHASES``. The last is 4: a rule is stored as three numbers (two symbols and a
length) and a replacement saves one, so under four occurrences nothing is gained.
After the first round of a phase only pairs beside a replacement, or passed over, can
be frequent, so the work of a shard is near linear.

The file holds for each shard the rules, the expansion length of each rule, the
symbols, and for each document its id, its first symbol and its number of ids, so
one document, or any range of ids in it, is decoded without the rest of the shard.

The files are written by Spark's Parquet writer (one row a shard, the arrays as
little-endian binary columns, zstd) into the shared folder: the output committer
makes the write survive lost executors, and any store that Spark writes will do.
The order of shards is (part, block); a row knows the ids before it in its part, and
the driver holds one sum for each part (8 bytes each, broadcast).

Defined results: null text = empty text (id 2 alone); ties of doc_id are ordered by
text; a null doc_id comes first; a very long text is a shard of its own; an empty table
gives an empty file and no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table, text_of

END = 2
VOCABULARY = 50_257
SHARD_TOKENS = 1 << 20
PHASES = (256, 32, 4)
_BITS = 20

FILE = "part int, block int, before bigint, n_tokens bigint, doc_ids binary, doc_symbols binary, doc_tokens binary, rules binary, expansions binary, symbols binary"


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys (pairs of symbols) in ascending order, and the keys so ordered."""
    left, right = key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)
    if len(key) >= 1 << 22 or max(int(left.max()), int(right.max())) >= 1 << 21:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    # Pair and place fit into one word, and words alone sort several times as fast.
    word = np.sort(left << np.uint64(43) | right << np.uint64(22) | np.arange(len(key), dtype=np.uint64))
    pair = word >> np.uint64(22)
    return (word & np.uint64((1 << 22) - 1)).astype(np.int64), (pair >> np.uint64(21)) << np.uint64(32) | (pair & np.uint64((1 << 21) - 1))


def _may_be_frequent(symbols: np.ndarray, last: np.ndarray, least: int) -> np.ndarray:
    """Places whose pair shares its slot of a hash table with ``least`` pairs: all places
    of frequent pairs, and some others."""
    h = symbols[:-1] * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    slot = ((h + symbols[1:]) * np.uint32(2246822519)) >> np.uint32(32 - _BITS)
    free = ~last[:-1]
    often = np.bincount(slot[free], minlength=1 << _BITS) >= least
    return np.flatnonzero(free & often[slot]).astype(np.int32)


def repair(ids: np.ndarray, last: np.ndarray, base: int = VOCABULARY, phases: tuple = PHASES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids of a shard; last: whether a document ends there. Returns rules (r, 2),
    expansion lengths of the rules, symbols, and whether a document ends at a symbol."""
    symbols, last = ids.astype(np.uint32), last.copy()
    rules, sizes = np.zeros((0, 2), np.uint32), np.zeros(0, np.int64)
    for least in phases:
        n = len(symbols)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        gone = np.zeros(n, bool)
        at = _may_be_frequent(symbols, last, least)
        while len(at):
            key = symbols[at].astype(np.uint64) << np.uint64(32) | symbols[after[at]]
            # In a run of one symbol every other place counts, from the left.
            run = np.zeros(len(at), bool)
            run[1:] = (after[at[:-1]] == at[1:]) & (key[1:] == key[:-1])
            passed = at[:0]
            if run.any():
                k = np.arange(len(at))
                odd = (k - np.maximum.accumulate(np.where(run, 0, k))) % 2 == 1
                passed, at, key = at[odd], at[~odd], key[~odd]
            order, ordered = _sorted(key)
            first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            times = np.diff(np.r_[first, len(ordered)])
            often = times >= least
            if not often.any():
                break
            pairs = ordered[first[often]]
            by = np.lexsort((pairs, -times[often]))
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            of_pair = np.full(len(first), -1, np.int32)
            of_pair[often] = rank
            r = np.empty(len(at), np.int32)
            r[order] = np.repeat(of_pair, times)
            at, r = at[r >= 0], r[r >= 0]
            # Of two occurrences that share a symbol, the better pair's is replaced.
            shared = after[at[:-1]] == at[1:]
            wins = np.ones(len(at), bool)
            wins[:-1] &= ~(shared & (r[:-1] > r[1:]))
            wins[1:] &= ~(shared & (r[1:] > r[:-1]))
            pays = np.bincount(r[wins], minlength=len(by)) >= least
            wins &= pays[r]
            place, r = at[wins], r[wins]
            new = pairs[by][pays]
            new = np.stack([new >> np.uint64(32), new & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
            symbols[place] = base + len(rules) + (np.cumsum(pays) - 1)[r]
            sizes = np.r_[sizes, _sizes(new, sizes, base).sum(axis=1)]
            rules = np.concatenate([rules, new])
            end = after[place]
            last[place], gone[end] = last[end], True
            after[place] = after[end]
            inner = after[place] < n
            before[after[place[inner]]] = place[inner]
            left = before[place]
            look = np.concatenate([passed, at[~wins], place, left[left >= 0]])
            if len(look) * 64 < n:
                at = np.unique(look)
            else:
                mark = np.zeros(n, bool)
                mark[look] = True
                at = np.flatnonzero(mark).astype(np.int32)
            at = at[~(gone[at] | last[at])]
        symbols, last = symbols[~gone], last[~gone]
    return rules, sizes, symbols, last


def _sizes(symbols: np.ndarray, sizes: np.ndarray, base: int) -> np.ndarray:
    """Ids that each symbol stands for."""
    if not len(sizes):
        return np.ones(symbols.shape, np.int64)
    rule = symbols.astype(np.int64) - base
    return np.where(rule >= 0, sizes[np.maximum(rule, 0)], 1)


def expand(symbols: np.ndarray, rules: np.ndarray, sizes: np.ndarray, base: int = VOCABULARY) -> np.ndarray:
    """The ids of symbols: a nonterminal's two sides go to their places, level by level."""
    n = _sizes(symbols, sizes, base)
    at = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.uint32)
    while len(symbols):
        deep = symbols >= base
        out[at[~deep]] = symbols[~deep]
        symbols, at = symbols[deep], at[deep]
        sides = rules[symbols - base] if len(symbols) else rules[:0]
        symbols, at = sides.T.ravel(), np.r_[at, at + _sizes(sides[:, 0], sizes, base)]
    return out


def slice_of(symbols: np.ndarray, rules: np.ndarray, expansions: np.ndarray, start: int, length: int, base: int = VOCABULARY) -> np.ndarray:
    """Random access: ids start..start+length of a document's symbols, expanding only
    the symbols that the range touches."""
    ends = np.cumsum(_sizes(symbols, expansions, base))
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + length, "left") + 1
    before = int(ends[a - 1]) if a else 0
    return expand(symbols[a:b], rules, expansions, base)[start - before : start - before + length]


def _shard(part: int, block: int, before: int, doc_ids: list, ids: list[np.ndarray]) -> tuple:
    n = np.array([len(x) for x in ids], np.int64)
    last = np.zeros(int(n.sum()), bool)
    last[np.cumsum(n) - 1] = True
    rules, sizes, symbols, ends = repair(np.concatenate(ids), last)
    first = np.concatenate([[0], np.flatnonzero(ends) + 1]).astype("<u4")
    null = np.array([x is None for x in doc_ids])
    known = np.array([0 if x is None else x for x in doc_ids], "<i8")
    head = known.tobytes() + null.tobytes()
    return part, block, before, int(n.sum()), head, first.tobytes(), n.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), symbols.astype("<u4").tobytes()


def _arrow(row: tuple) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6]
    names = [x.split()[0] for x in FILE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)


def write_tokens(docs: DataFrame, path: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the ids of docs (doc_id, text) as files at path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .byte_bpe import encoder

        enc, end = encoder(), np.array([END], np.uint32)
        part, block, before, held, doc_ids, ids = TaskContext.get().partitionId(), 0, 0, 0, [], []
        for b in batches:
            for doc_id, x in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1).to_pylist()), strict=True):
                ids.append(np.concatenate([x, end]))
                doc_ids.append(doc_id)
                held += len(ids[-1])
                if held >= shard_tokens:
                    yield _arrow(_shard(part, block, before, doc_ids, ids))
                    block, before, held, doc_ids, ids = block + 1, before + held, 0, [], []
        if ids:
            yield _arrow(_shard(part, block, before, doc_ids, ids))

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of().alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, FILE).write.option("compression", "zstd").parquet(path)


def documents_of(row: dict) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, ids in each document, and all ids of a shard's row."""
    tokens = np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64)
    m = len(tokens)
    known, null = np.frombuffer(row["doc_ids"], "<i8", m), np.frombuffer(row["doc_ids"], bool, m, 8 * m)
    sizes = np.frombuffer(row["expansions"], "<u4").astype(np.int64)
    ids = expand(np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["rules"], "<u4").reshape(-1, 2), sizes)
    return [None if x else k for k, x in zip(known.tolist(), null.tolist(), strict=True)], tokens, ids


def read_document(row: dict, k: int, start: int = 0, length: int | None = None) -> np.ndarray:
    """Ids of the k-th document of a shard, or a range of them, from its symbols alone."""
    first = np.frombuffer(row["doc_symbols"], "<u4")
    n = int(np.frombuffer(row["doc_tokens"], "<u4")[k])
    symbols = np.frombuffer(row["symbols"], "<u4")[first[k] : first[k + 1]]
    rules, sizes = np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["expansions"], "<u4").astype(np.int64)
    return slice_of(symbols, rules, sizes, start, n - start if length is None else length)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    files = spark.read.schema(FILE).parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens")).collect()  # one number a part
    before = np.zeros(max((r[0] for r in sums), default=-1) + 2, np.int64)
    before[[r[0] + 1 for r in sums]] = [r[1] for r in sums]
    held = spark.sparkContext.broadcast(np.cumsum(before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                doc_ids, tokens, ids = documents_of(row)
                ends = np.cumsum(tokens)
                begin = ends - tokens
                crc = [zlib.crc32(ids[a:e].tobytes()) for a, e in zip(begin.tolist(), ends.tolist(), strict=True)]
                columns = [doc_ids, begin + held.value[row["part"]] + row["before"], tokens, crc]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)
