"""Packing of token ids into sequences by Karmarkar-Karp multiway differencing.

A document's ids (public byte-level BPE, then id 1) are first cut into full windows
of ``capacity`` ids, each a sequence of its own (nothing could share it, so
differencing would leave it alone), and a rest. Rests are cut to pieces of at most
``piece`` ids and gathered, in order, into batches that fill ``windows`` windows but
for ``slack`` ids each; the last piece of a batch is cut so that the batch is full. The
pieces of a batch are then partitioned by multiway differencing: every piece starts as
a partial partition with one filled window; the two partial partitions with the
largest imbalance are merged with their windows in opposing order, until one is left.

Windows come out within some 20 ids of each other. Those over the capacity exchange
single pieces with others as long as that lowers the larger of the two; what is then
still over is cut off, if another window has room for it, as documents may be cut
anywhere. If none has, the window count rises by one and the differencing runs again.

Plan: no shuffle. Each input partition is packed by itself in a stream (memory: one
batch of rows and one of pieces), so the result depends on the partition's rows alone
and a repeated task writes the same rows. ``sequence_id`` is (partition << 33) + a
counter: unique, not gapless. Padding: ``slack`` of a window in batches (0.2 %), one
part-filled batch a partition.

Defined results: null text = empty text, one piece with id 1 alone; a null doc_id is
kept as null; repeated rows are packed each; a very long text is cut into as many
windows as it fills; an empty table gives no rows; extra columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, text_of

CAPACITY = 2048
PIECE = 1024
WINDOWS = 128
SLACK = 4
END = 1

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_TYPES = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


def difference(sizes: list[int], windows: int) -> np.ndarray:
    """The window of each piece: Karmarkar-Karp with ``windows`` parts.

    A partial partition is a vector of window sums, ascending and with its least sum
    subtracted, beside the lists of pieces in its windows."""
    n = len(sizes)
    sums: list = [None] * n
    held: list = [None] * n
    queue = []
    for i, s in enumerate(sizes):
        sums[i] = np.zeros(windows, np.int64)
        sums[i][-1] = s
        held[i] = [()] * (windows - 1) + [(i,)]
        queue.append((-s, i))
    heapq.heapify(queue)
    while len(queue) > 1:
        i, j = heapq.heappop(queue)[1], heapq.heappop(queue)[1]
        both = sums[i] + sums[j][::-1]
        order = np.argsort(both, kind="stable")
        a, b = held[i], held[j]
        # A window is a pair of windows: a tree that is walked once at the end.
        held[i] = [a[k] if not b[windows - 1 - k] else (b[windows - 1 - k] if not a[k] else (a[k], b[windows - 1 - k])) for k in order.tolist()]
        sums[i] = both[order] - both[order[0]]
        sums[j] = held[j] = None
        heapq.heappush(queue, (-int(sums[i][-1]), i))
    out = np.zeros(n, np.int64)
    if n:
        for w, tree in enumerate(held[queue[0][1]]):
            stack = [tree]
            while stack:
                t = stack.pop()
                for x in t:
                    if isinstance(x, int):
                        out[x] = w
                    else:
                        stack.append(x)
    return out


def exchange(sizes: np.ndarray, at: np.ndarray, windows: int, capacity: int) -> np.ndarray:
    """Lowers the fullest window by exchanging one of its pieces, while it is over."""
    at, load = at.copy(), np.bincount(at, sizes, windows).astype(np.int64)
    while load[full := int(load.argmax())] > capacity:
        own = np.flatnonzero(at == full)
        less = sizes[own][:, None] - sizes[None, :]
        worst = np.maximum(load[full] - less, load[at][None, :] + less)
        worst[:, own] = load[full]
        i, j = divmod(int(worst.argmin()), len(sizes))
        if worst[i, j] >= load[full]:
            break
        load[full] -= less[i, j]
        load[at[j]] += less[i, j]
        at[own[i]], at[j] = at[j], full
    return at


def windows_of(sizes: list[int], capacity: int = CAPACITY) -> tuple[np.ndarray, int, list[tuple[int, int, int]]]:
    """A window for each piece, the number of windows, and cuts (piece, ids to cut off its
    end, window that takes them): with them no window is over the capacity."""
    size = np.array(sizes, np.int64)
    k = max(1, -(-int(size.sum()) // capacity))
    while True:
        at = exchange(size, difference(sizes, k), k, capacity)
        room = capacity - np.bincount(at, size, k).astype(np.int64)
        cuts = []
        for w in np.flatnonzero(room < 0).tolist():
            to, own = int(room.argmax()), np.flatnonzero(at == w)
            longest = int(own[size[own].argmax()])
            if room[to] < -room[w] or size[longest] <= -room[w]:
                break
            cuts.append((longest, int(-room[w]), to))
            room[to] += room[w]
            room[w] = 0
        if room.min(initial=0) >= 0:
            return at, k, cuts
        k += 1


class Packer:
    """A stream of documents in, rows of pieces out."""

    def __init__(self, first: int = 0, capacity: int = CAPACITY, piece: int = PIECE, windows: int = WINDOWS, slack: int = SLACK):
        self.next, self.capacity, self.piece = first, capacity, piece
        self.room = windows * (capacity - slack)
        self.left, self.batch = self.room, []
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.capacity:
            self._row((doc_id, at, ids[at : at + self.capacity], n), self.next, 0)
            self.next += 1
            at += self.capacity
        while at < n:
            take = min(n - at, self.piece, self.left)
            self.batch.append((doc_id, at, ids[at : at + take], n))
            at += take
            self.left -= take
            if not self.left:
                self.close()

    def _row(self, piece: tuple, sequence: int, offset: int) -> None:
        doc_id, start, ids, n = piece
        self.rows.append((doc_id, start, len(ids), zlib.crc32(ids), n, sequence, offset))

    def close(self) -> None:
        """Packs the batch."""
        at, k, cuts = windows_of([len(p[2]) for p in self.batch], self.capacity)
        placed = list(zip(self.batch, at.tolist(), strict=True))
        for i, over, to in cuts:
            (doc_id, start, ids, n), w = placed[i]
            keep = len(ids) - over
            placed[i] = (doc_id, start, ids[:keep], n), w
            placed.append(((doc_id, start + keep, ids[keep:], n), to))
        used = [0] * k
        for p, w in placed:
            self._row(p, self.next + w, used[w])
            used[w] += len(p[2])
        self.next += k if self.batch else 0
        self.left, self.batch = self.room, []

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_TYPES)


def pack(docs: DataFrame, capacity: int = CAPACITY, piece: int = PIECE, windows: int = WINDOWS, slack: int = SLACK) -> DataFrame:
    """One row for each piece of each document of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .byte_bpe import encoder

        enc, end = encoder(), np.array([END], np.uint32)
        packer = Packer(TaskContext.get().partitionId() << 33, capacity, piece, windows, slack)
        for b in slices(batches, 2048):
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1).to_pylist()), strict=True):
                packer.add(doc_id, np.concatenate([ids, end]))
                if len(packer.rows) >= 20_000:
                    yield packer.take()
        packer.close()
        yield packer.take()

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of().alias("text")).mapInArrow(run, SCHEMA)


def op4_kk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
