import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tessera.llm import near_copies
from tessera.llm.common import table
from tessera.llm.near_copies import drop_near

from .conftest import DOCUMENTS


def brute(rows):
    """doc_ids that stay, by all pairs."""
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c for c in t or "").split(" ")
        w = [x for x in w if x]
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i in ids:
        some = {}
        for x in sets[i]:
            for j in by.setdefault(x, []):
                some[j] = some.get(j, 0) + 1
            by[x].append(i)
        for j, n in some.items():
            if n * 5 >= (len(sets[i]) + len(sets[j]) - n) * 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    blank = [i for i in ids if not sets[i]]
    return {i for i in ids if find(i) == i} - set(blank[1:])


def test_against_all_pairs(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").dropDuplicates(["doc_id"])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [r.doc_id for r in drop_near(docs).select("doc_id").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_changed_copies_chains_and_unlike_texts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(20):
        w = [word() for _ in range(200)]
        for _ in range(5):  # a chain: each is near the one before, the ends are not near each other
            texts.append(" ".join(w))
            for _ in range(3):
                w[rng.randrange(len(w))] = word()
        half = w[:100] + [word() for _ in range(100)]
        texts.append(" ".join(half))
    rng.shuffle(texts)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    got = {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").select("doc_id").collect()}
    want = brute([r[:2] for r in rows])
    assert got == want and len(want) < 80


@pytest.mark.parametrize("block", [1 << 22, 6000])
def test_a_large_group_of_which_many_are_not_alike(spark, monkeypatch, block):
    """Copies with few and with many changes share keys; links are those of all pairs, and
    pairs that are not alike are never rows."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, rows = [word() for _ in range(150)], []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w), "en", "s", 0))
    docs = spark.createDataFrame(rows, DOCUMENTS)
    want = brute([r[:2] for r in rows])
    assert {r.doc_id for r in drop_near(docs).select("doc_id").collect()} == want and 5 < len(want) < 150


def test_blocks_of_a_bucket_by_plain_search():
    """Links inside a block and across two, without pairs of an earlier band."""
    rng = np.random.default_rng(3)
    base = np.sort(rng.choice(1 << 60, 40, replace=False).astype(np.uint64))
    sets = [np.sort(np.r_[base[rng.permutation(40)[:k]], rng.choice(1 << 60, 40 - k).astype(np.uint64)]) for k in rng.integers(34, 41, 30)]
    ks = np.arange(30 * near_copies.BANDS).reshape(30, -1) + 1000
    ks[:, 3] = 7  # the bucket
    ks[:10, 1] = 5  # these share an earlier key
    for p, q in ((0, 0), (0, 1)):
        block = np.zeros(30, int) if p == q else np.arange(30) % 2
        t = pa.table({"key": [7] * 30, "p": [p] * 30, "q": [q] * 30, "own": block, "node": np.arange(30) * 3, "root": np.arange(30) // 4, "hashes": [x.tobytes() for x in sets], "keys": ks.tolist()})
        got = near_copies._bucket_links(t.take(pa.array(rng.permutation(30)))).to_pylist()
        tied = list(range(30))

        def join(tied, i, j):
            return [tied[i] if x == tied[j] else x for x in tied]

        first = [tied.index(i) for i in np.unique(np.arange(30) // 4, return_index=True)[1][np.arange(30) // 4]]
        want = mine = first
        for i in range(30):
            for j in range(i):
                if (p == q or block[i] != block[j]) and not (i < 10 and j < 10) and near_copies.alike(sets[i], sets[j]):
                    want = join(want, i, j)
        for r in got:
            assert near_copies.alike(sets[r["a"] // 3], sets[r["b"] // 3])
            mine = join(mine, r["a"] // 3, r["b"] // 3)
        same = lambda x: [[a == b for b in x] for a in x]
        assert same(mine) == same(want) and len(got) < 30


def test_hard_rows(spark, hard, empty):
    got = drop_near(hard)
    assert got.columns == hard.columns and drop_near(empty).count() == 0
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "5", "6", "None"]


@pytest.mark.parametrize("shard", [15, 60, 4000])
def test_trees_find_every_candidate(spark, shard):
    """Fingerprints in vantage-point trees against all pairs: near copies of sets of all sizes."""
    rng = np.random.default_rng(5)
    sets = []
    for n in [4, 5, 8, 12, 30, 100, 400, 2000] * 6:
        base = rng.choice(1 << 62, n, replace=False).astype(np.uint64)
        sets += [np.unique(np.r_[base[k:], rng.choice(1 << 62, k).astype(np.uint64)]) for k in (0, *rng.integers(0, max(1, n // 8) + 1, 4))]
    sets = list({near_copies.node(x): x for x in sets}.values())
    fps = [near_copies.fingerprint(x) for x in sets]
    rows = [(i, len(x), bytearray(f.tobytes())) for i, (x, f) in enumerate(zip(sets, fps, strict=True))]
    links = near_copies.near_points(spark.createDataFrame(rows, "node bigint, size bigint, fp binary"), shard)
    stars = {r.a: r.b for r in near_copies.components(links).collect()}
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = int(np.bitwise_count(fps[i] ^ fps[j]).sum())
            u, v = (round(np.log(len(sets[k])) * near_copies.RADIUS / np.log(1.25)) for k in (i, j))
            near = max(both, abs(u - v)) <= near_copies.RADIUS + 1
            assert near or not near_copies.alike(sets[i], sets[j])
            if near and want[i] != want[j]:
                lo, hi = sorted((want[i], want[j]))
                want = [lo if x == hi else x for x in want]
    assert [stars.get(i, i) for i in range(len(sets))] == want and len(set(want)) < len(want) / 2
