import math
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm.common import table
from tessera.llm.search import Shard, _index, search, words

from .conftest import SF


def bag(text):
    return Counter(re.findall(r"\w+", (text or "").lower()))


def brute(rows, queries, top=10):
    """(doc_id, score) of each query's hits in order, a null doc_id first of equals."""
    docs = [(i, bag(t)) for i, t in rows]
    mean = sum(sum(c.values()) for _, c in docs) / len(docs)
    df = Counter(w for _, c in docs for w in c)
    out = {}
    for q, text in queries:
        t, scored = bag(text), []
        for i, c in docs:
            norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
            s = math.fsum(n * math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + norm) for w, n in t.items() if w in c)
            if s > 0:
                scored.append((-round(s, 9), i is not None, i or 0))
        out.setdefault(q, []).append([(i if known else None, -s) for s, known, i in sorted(scored)[:top]])
    return out


@pytest.mark.parametrize("which, postings", [("small", 4_000_000), ("small", 6_000), ("hard", 12)])
def test_against_brute_force(spark, hard, which, postings):
    docs = hard if which == "hard" else table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    asking = docs.where("doc_id % 10 = 0") if which == "small" else docs
    queries = {(i, t) for i, t in rows if i is not None and (which == "hard" or i % 10 == 0)}
    want = brute(rows, queries)
    got = {}
    for r in search(docs, asking, postings=postings, pairs=500).orderBy("query_id", "query_key", "rank").collect():
        got.setdefault(r.query_id, {}).setdefault(r.query_key, []).append((r.rank, r.doc_id, r.score))
    assert set(got) == {q for q, h in want.items() if any(h)}
    for q, lists in got.items():
        mine = sorted(([i for _, i, _ in hits], [s for *_, s in hits]) for hits in lists.values())
        for (ids, scores), hits in zip(mine, sorted(([i for i, _ in h], [s for _, s in h]) for h in want[q]), strict=True):
            assert ids == hits[0]  # the order and the ties
            assert scores == pytest.approx(hits[1], abs=1e-8)
        assert all([k for k, *_ in hits] == list(range(1, len(hits) + 1)) for hits in lists.values())


def test_rows_that_repeat_an_id_ask_each(spark):
    docs = spark.createDataFrame([(100, "red apple"), (100, "green pear"), (1, "apple"), (2, "pear pear"), (3, None)], "doc_id bigint, text string")
    got = search(docs, docs.where("doc_id % 100 = 0")).collect()
    lists = {}
    for r in got:
        lists.setdefault(r.query_key, set()).add(r.doc_id)
    assert sorted(map(sorted, lists.values())) == [[1, 100], [2, 100]]


def shard_of(texts):
    bags = [words(t) for t in texts]
    pairs = [(np.fromiter(b, np.int64, len(b)), np.fromiter(b.values(), np.int32, len(b))) for b in bags]
    row = _index(len(texts), list(range(len(texts))), pairs).to_pylist()[0]
    return Shard(row, float(np.mean([sum(b.values()) for b in bags])), tile=64), bags


def test_blocks_are_skipped_and_nothing_is_lost(spark):
    """Most documents are never scored, yet ids, order and scores are those of scoring all."""
    texts = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").orderBy("doc_id").collect()]
    texts = [t for t in texts if words(t or "")]
    shard, bags = shard_of(texts)
    df = Counter(k for b in bags for k in b)
    n, share = len(texts), []
    for q in range(0, n, 13):
        terms = np.array(sorted(bags[q]), np.int64)
        weights = np.array([bags[q][t] * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in terms.tolist()])
        before = shard.scored
        ids, scores = shard.search(terms, weights, 10)
        share.append((shard.scored - before) / n)
        full = np.zeros(n)
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            k = np.searchsorted(shard.terms, t)
            at = slice(shard.first[k], shard.first[k + 1])
            full[shard.ids[shard.places[at]]] += w * shard.impact[at]
        full = np.round(full, 9)
        order = np.lexsort((np.arange(n), -full))[:10]
        assert ids.tolist() == order.tolist() and scores == pytest.approx(full[order], abs=2e-9)
    assert np.mean(share) < 0.5


def test_empty(empty):
    assert search(empty, empty).count() == 0
