import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.common import table
from tessera.llm.exact_dedup import CuckooIndex, dedup, digests, drop_copies, groups

from .conftest import SF


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        h = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()
        groups.setdefault(h, []).append(doc_id)
    out = []
    for h, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, h) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("which", ["hard", "small"])
def test_against_brute_force(spark, hard, which):
    docs = hard if which == "hard" else table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_drop_copies_keeps_one_row_of_each_text(spark, hard):
    got = [r.doc_id for r in drop_copies(hard).collect()]
    assert sorted(got, key=str) == sorted([1, 2, 5, 6, 7, None], key=str)
    assert drop_copies(hard).columns == hard.columns


def test_empty(empty):
    assert dedup(empty).count() == 0 and drop_copies(empty).count() == 0


def test_rows_that_repeat_an_id(spark):
    """Of one doc_id with equal texts one row stays, also where white space or other columns differ."""
    rows = [(1, "a b", "x"), (1, "a  b", "y"), (1, "a b", "z"), (2, "a\tb", "x"), (1, "c", "x"), (3, "c", "x"), (None, "d", "x"), (None, "d ", "x"), (None, "d", "y"), (5, "e", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({c: F.lit("own") for c in ("__row", "__k_id", "digest", "row", "id", "least", "n", "stays")})
    for parts in (1, 4):
        got = drop_copies(docs.repartition(parts))
        assert got.columns == docs.columns
        texts = sorted(((r.doc_id, " ".join(r.text.split())) for r in got.collect()), key=str)
        assert texts[:4] == sorted([(1, "a b"), (1, "c"), (5, "e"), (None, "d")], key=str)[:4] and len(texts) == 5  # "d" and "d " differ


def test_many_keys_are_joined_and_few_broadcast(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    want = {i for i, k, *_ in brute([(r.doc_id, r.text) for r in docs.collect()]) if i == k}
    assert {r.doc_id for r in drop_copies(docs).collect()} == want
    monkeypatch.setattr(common, "KEYS", 1)
    assert {r.doc_id for r in drop_copies(docs).collect()} == want


@pytest.mark.parametrize("max_live", [1, 2, 7])
def test_full_indexes_lose_nothing(spark, max_live):
    rows = [(i, f"text {i % 11}") for i in range(60)]
    digested = digests(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    got = {(r.keep_id, r.group_size) for r in groups(digested, max_live).collect()}
    assert got == {(k, len(range(k, 60, 11))) for k in range(11)}


def test_index_inserts_deletes_and_restores_on_overflow():
    index, rng = CuckooIndex(16), random.Random(1)
    keys = [rng.randbytes(32) for _ in range(200)]
    live = []
    for k in keys:
        before = list(index.tags), list(index.keys)
        if index._insert(k, [k]):
            live.append(k)
        else:
            assert (index.tags, index.keys) == before
    assert 40 < len(live) <= 64 and all(index.get(k) == [k] for k in live)
    for k in live:
        assert index.remove(k) == [k]
    assert len(index) == 0 and not any(index.tags) and not any(index.keys)


def test_index_resizes_from_stored_keys_and_verifies_hits():
    index, rng = CuckooIndex(4), random.Random(2)
    keys = [rng.randbytes(32) for _ in range(5000)]
    for i, k in enumerate(keys):
        assert index.get(k) is None
        index.put(k, [i])
    assert index.resizes > 3 and all(index.get(k) == [i] for i, k in enumerate(keys))
    false = keys[0][:10] + b"\0" * 22  # same buckets and tag, other key
    assert index.places(false) == index.places(keys[0]) and index.get(false) is None
    index.put(false, ["false"])
    assert index.get(false) == ["false"] and index.get(keys[0]) == [0]
    for k in keys[::2]:
        index.remove(k)
    assert len(index) == 2501 and index.get(keys[0]) is None and index.get(keys[1]) == [1] and index.get(false) == ["false"]
    assert dict(index.items())[keys[3]] == [3]


def test_index_equals_a_dictionary():
    index, plain, rng = CuckooIndex(4), {}, random.Random(7)
    keys = [rng.randbytes(32) for _ in range(300)]
    for step in range(20_000):
        k = rng.choice(keys)
        if rng.random() < 0.5:
            if index.get(k) is None:
                index.put(k, [step])
                plain[k] = [step]
        else:
            assert index.remove(k) == plain.pop(k, None)
        assert len(index) == len(plain)
    assert dict(index.items()) == plain
