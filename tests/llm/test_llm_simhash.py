import random

import numpy as np
import pytest
import xxhash

from tessera.llm.common import table
from tessera.llm.simhash import components, connect, fingerprint, keep_one, links, near_duplicates

from .conftest import DOCUMENTS, SF


def brute(rows):
    fps = {}
    for doc_id, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in "".join(" " if c in "\t\n\v\f\r" else c for c in w).split(" ") if x]
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fps[doc_id] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    ids = list(fps)
    comp = {i: i for i in ids}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)), key=lambda x: (x is None, x or 0))
                comp[b] = a
    return {(i, f"{fps[i]:016x}", find(i)) for i in ids}


@pytest.mark.parametrize("which", ["hard", "small"])
def test_against_brute_force(spark, hard, which):
    docs = hard if which == "hard" else table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows) and set(map(tuple, got)) == brute(rows)


def test_keep_one_and_empty(spark, hard, empty):
    assert near_duplicates(empty).count() == 0
    got = keep_one(hard)
    assert got.columns == hard.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "5", "6", "None"]


def cluster_words(n, seed):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 3, 12])):
            out.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    return np.array(sorted(out), np.uint64)


def roots(words):
    d = np.bitwise_count(words[:, None] ^ words[None, :]) <= 2
    label = np.arange(len(words))
    while True:
        new = np.where(d, label[None, :], len(words)).min(1)
        if (new == label).all():
            return label
        label = new


def test_tree_finds_every_pair():
    words = cluster_words(1500, 1)
    assert (connect(words, np.ones(len(words), bool)) == roots(words)).all()


@pytest.mark.parametrize("shard", [100, 400, 5000])
def test_shards_lose_no_link(spark, shard):
    words = cluster_words(1500, 2)
    signed = words.view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in signed], "fp bigint").repartition(3)
    stars = {r.a: r.b for r in components(links(df, len(words), shard=shard)).collect()}
    label = roots(words)
    smallest = {}
    for x, l in zip(signed.tolist(), label.tolist()):
        smallest[l] = min(x, smallest.get(l, x))
    assert {x: stars.get(x, x) for x in signed.tolist()} == {x: smallest[l] for x, l in zip(signed.tolist(), label.tolist())}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1200)] + [(7, 7), (5000, 4000)]
    got = {r.a: r.b for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 1000 for i in range(1001, 1200)}, 5000: 4000}


def test_long_text_and_bits():
    assert fingerprint("") == fingerprint(None) == fingerprint(" \n") == 0
    assert fingerprint("A b") == fingerprint("a  B") != fingerprint("b a")
    assert fingerprint("w " * 200_000) == fingerprint("w w w")
