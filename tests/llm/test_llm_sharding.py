import zlib

import numpy as np
import pytest

from tessera.llm.common import table
from tessera.llm.sharding import SEED, SHARDS, op3_feistel_sharding, permute, place, row_at, shard_documents

from .conftest import SF


@pytest.mark.parametrize("n", [1, 2, 3, 5, 40, 41, 1000, 4097])
def test_permutation_and_inverse(n):
    rows = np.arange(n)
    p = permute(rows, n)
    assert sorted(p) == list(range(n)) and (permute(p, n, back=True) == rows).all()
    shard, slot = place(rows, n, 7)
    assert (row_at(shard, slot, n, 7) == rows).all()


def scalar_place(row, n, shards, seed):
    """Shard and slot by plain integers: six rounds over two halves, walked until inside."""
    word = (1 << 64) - 1

    def mix(x, key):
        x = (x + key) * 0x9E3779B97F4A7C15 & word
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & word
        return x ^ (x >> 29)

    bits = max(2, (max(n, 2) - 1).bit_length())
    lo, hi = bits // 2, bits - bits // 2
    keys = [mix(i, seed) for i in range(1, 7)]
    x = row
    while True:
        b, a = x % (1 << lo), x >> lo
        for i, k in enumerate(keys):
            if i % 2:
                b ^= mix(a, k) % (1 << lo)
            else:
                a ^= mix(b, k) % (1 << hi)
        x = (a << lo) | b
        if x < n:
            return x % shards, x // shards


@pytest.mark.parametrize("n, shards, seed", [(1, 1, 0), (2, 3, 5), (41, 40, SEED), (1000, 7, SEED), (4097, 40, 99)])
def test_places_equal_plain_integers(n, shards, seed):
    shard, slot = place(np.arange(n), n, shards, seed)
    assert list(zip(shard.tolist(), slot.tolist())) == [scalar_place(r, n, shards, seed) for r in range(n)]


def test_documents_are_at_the_places_of_their_ranks(spark):
    """Every document of a table against rank and place by plain Python."""
    docs = table(spark, SF, "documents")
    rows = sorted((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    want = {row: scalar_place(k, len(rows), SHARDS, SEED) for k, row in enumerate(rows)}
    got = op3_feistel_sharding(spark, SF).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.size, r.text_crc32): (r.shard, r.slot) for r in got} == want


def test_shuffles():
    p = permute(np.arange(10_000), 10_000)
    assert abs(np.corrcoef(np.arange(10_000), p)[0, 1]) < 0.05
    assert (permute(np.arange(10_000), 10_000, seed=3) != p).mean() > 0.99


@pytest.mark.parametrize("parts", [1, 3])
def test_documents(hard, parts):
    docs = hard.repartition(parts)
    got = shard_documents(docs, shards=4).toPandas()
    assert len(got) == 10 and set(got["law"]) == {"rows"} and got["grown_shard"].isna().all()
    counts = got.groupby("shard").size()
    assert counts.max() - counts.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    want = sorted((len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in hard.collect())
    assert sorted(zip(got["size"], got["text_crc32"])) == want
    again = shard_documents(hard.coalesce(1), shards=4).toPandas()
    key = ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert sorted(map(str, again[key].values.tolist())) == sorted(map(str, got[key].values.tolist()))


def test_empty(empty):
    assert shard_documents(empty).count() == 0
