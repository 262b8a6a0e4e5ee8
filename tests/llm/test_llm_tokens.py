import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import byte_bpe
from tessera.llm.byte_bpe import Encoder
from tessera.llm.common import scratch, table
from tessera.llm.packing import CAPACITY, Packer, difference, pack, windows_of
from tessera.llm.token_output import FILE, PHASES, documents_of, expand, read_document, read_tokens, repair, slice_of, write_tokens

from .conftest import SF


@pytest.fixture(scope="module")
def enc():
    return Encoder()


TEXTS = [
    "  a  b\n\n c\t d 'scan it's I'LL we'll 12a3 ½ ² x\x1cy z <|endoftext|>x", "", "\n", "a" * 5000, " " * 1200, "日本語 text",
    " ’s ‘don’t’ don't…", "a\x85b", "１２３ abc", "x\n\n\ny   z  ", "ſİ ŉ ß", "a\xa0b \xa0 c", "​x 😀😀", "don't'll x's'", "a" * 900 + " 日" + "b" * 1200,
]


def test_encoder_equals_the_library(spark, enc):
    texts = TEXTS + [r.text for r in table(spark, SF, "documents").collect()]
    rng = random.Random(5)
    alphabet = "ab  \n\t'sé—12½日😀_.\r\x0b\x1f"
    texts += ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(300)]
    want = [enc.whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in enc.encode_all(texts)] == want
    for t, x in zip(texts[::7], want[::7], strict=True):
        assert enc.encode(t).tolist() == x, t


def test_encoder_cuts_long_texts_and_forgets_nothing(enc, monkeypatch):
    rng = random.Random(8)
    words = ["it's", "we'll", "a", " ", "\n\n", "12", "?!", "'", "  x", "\t", "é", "don't'", "'s"]
    text = " ".join(rng.choice(words) for _ in range(3000))
    want = enc.whole.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(byte_bpe, "CHARACTERS", 64)
    monkeypatch.setattr(byte_bpe, "_REMEMBER", 40)
    small = Encoder()
    for t in (text, text + " 日", "x" * 300, text[:500] + "y" * 90 + text[:200]):
        assert small.encode(t).tolist() == enc.whole.encode(t, add_special_tokens=False).ids
    assert small.encode(text).tolist() == want


def ids_of(enc, text, end):
    return np.array([*enc.whole.encode(text or "", add_special_tokens=False).ids, end], np.uint32)


def scalar_difference(sizes, k):
    """Karmarkar-Karp by plain lists: windows of (sum, pieces), ascending."""
    parts = {i: [(0, [])] * (k - 1) + [(s, [i])] for i, s in enumerate(sizes)}
    while len(parts) > 1:
        i, j = sorted(parts, key=lambda p: (parts[p][0][0] - parts[p][-1][0], p))[:2]
        a, b = parts[i], parts.pop(j)
        parts[i] = sorted(((a[w][0] + b[k - 1 - w][0], a[w][1] + b[k - 1 - w][1]) for w in range(k)), key=lambda x: x[0])
    out = [0] * len(sizes)
    for w, (_, pieces) in enumerate(next(iter(parts.values()), [])):
        for x in pieces:
            out[x] = w
    return out


def test_difference_equals_a_scalar_one():
    rng = random.Random(4)
    for n, k in ((0, 3), (1, 1), (5, 2), (40, 4), (60, 9), (12, 16)):
        for high in (3, 40, 900):
            sizes = [rng.randint(1, high) for _ in range(n)]
            assert difference(sizes, k).tolist() == scalar_difference(sizes, k)


def test_difference_balances():
    rng = random.Random(3)
    for k in (1, 2, 5, 16):
        sizes = [rng.randint(1, 500) for _ in range(12 * k)]
        at = difference(sizes, k)
        sums = np.bincount(at, sizes, k)
        assert len(at) == len(sizes) and sums.max() - sums.min() <= 0.1 * sums.mean() + 1
    at, k, cuts = windows_of([1500] * 5)
    assert k == 5 and len(set(at.tolist())) == 5 and not cuts  # the count rises from 4
    for sizes in ([1030] * 4, [1020, 1027, 1000, 1047, 2], [rng.randint(1, 1024) for _ in range(400)]):
        at, k, cuts = windows_of(sizes)
        load = np.bincount(at, sizes, k)
        for i, over, to in cuts:
            assert 0 < over < sizes[i]
            load[at[i]] -= over
            load[to] += over
        assert load.max() <= CAPACITY


def test_little_padding():
    rng, packer = random.Random(9), Packer()
    total = 0
    for i in range(6000):
        n = min(20_000, int(rng.lognormvariate(5.8, 1.1)) + 1)
        total += n
        packer.add(i, np.zeros(n, np.uint32))
    last = packer.next
    used = sum(r[2] for r in packer.rows)
    assert used / (last * CAPACITY) > 0.997
    packer.close()
    assert sum(r[2] for r in packer.rows) == total


@pytest.mark.parametrize("which", ["hard", "small"])
def test_packing_covers_each_id_once(spark, enc, hard, which):
    docs = hard if which == "hard" else table(spark, SF, "documents")
    got = pack(docs).toPandas()
    texts, copies = {}, Counter()
    for r in docs.collect():  # rows that repeat a doc_id repeat its text
        key = -1 if r.doc_id is None else r.doc_id
        texts[key] = ids_of(enc, r.text, 1)
        copies[key] += 1
    got["doc_id"] = got["doc_id"].fillna(-1).astype(int)
    assert set(got["doc_id"]) == set(texts)
    for doc_id, g in got.groupby("doc_id"):
        x = texts[doc_id]
        times = np.zeros(len(x), int)
        for r in g.itertuples():
            assert r.length > 0 and r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes())
            times[r.start : r.start + r.length] += 1
        assert (times == copies[doc_id]).all()
    used = 0
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= CAPACITY
        used += 1
    if which == "small":
        assert got["length"].sum() / (used * CAPACITY) > 0.97


def test_packing_empty(empty, hard):
    assert pack(empty).count() == 0
    assert pack(hard).where("doc_id is null").count() == 1


def scalar_repair(docs, base, phases):
    """The same rounds by plain lists and dictionaries, every round over everything."""
    rules = []
    for least in phases:
        while True:
            places = {}
            for d, x in enumerate(docs):
                taken = -1
                for i in range(len(x) - 1):
                    if x[i] == x[i + 1] and i > 0 and x[i - 1] == x[i] and taken == i - 1:
                        continue  # overlaps the occurrence before it in the run
                    taken = i
                    places.setdefault((x[i], x[i + 1]), []).append((d, i))
            often = sorted((p for p in places if len(places[p]) >= least), key=lambda p: (-len(places[p]), p))
            if not often:
                break
            rank = {o: k for k, p in enumerate(often) for o in places[p]}
            wins = {o: k for (o, k) in rank.items() if rank.get((o[0], o[1] - 1), k) >= k and rank.get((o[0], o[1] + 1), k) >= k}
            pays = [k for k in range(len(often)) if sum(v == k for v in wins.values()) >= least]
            number = {k: base + len(rules) + j for j, k in enumerate(pays)}
            rules += [often[k] for k in pays]
            for d, x in enumerate(docs):
                out, i = [], 0
                while i < len(x):
                    k = wins.get((d, i))
                    out.append(number[k] if k in number else x[i])
                    i += 2 if k in number else 1
                docs[d] = out
    return rules, docs


@pytest.mark.parametrize("phases", [(4,), (8, 3), (2,)])
def test_repair_equals_a_scalar_one(phases):
    rng = np.random.default_rng(7)
    for letters in (2, 3, 12):
        docs = [rng.integers(0, letters, rng.integers(1, 90)).tolist() for _ in range(25)] + [[1] * 37, [0, 0, 0], [2] * 5 + [0] * 6]
        ids = np.array([x for d in docs for x in d], np.uint32)
        last = np.zeros(len(ids), bool)
        last[np.cumsum([len(d) for d in docs]) - 1] = True
        rules, sizes, symbols, ends = repair(ids, last, base=100, phases=phases)
        want, left = scalar_repair([list(d) for d in docs], 100, phases)
        assert list(map(tuple, rules.tolist())) == want
        assert symbols.tolist() == [x for d in left for x in d]
        assert np.flatnonzero(ends).tolist() == (np.cumsum([len(d) for d in left]) - 1).tolist()
        assert (expand(symbols, rules, sizes, 100) == ids).all()


def test_no_pair_is_left_that_pays(spark, enc):
    texts = [r.text for r in table(spark, SF, "documents").limit(150).collect()]
    docs = [ids_of(enc, t, 2) for t in texts]
    last = np.zeros(sum(map(len, docs)), bool)
    last[np.cumsum([len(d) for d in docs]) - 1] = True
    ids = np.concatenate(docs)
    rules, sizes, symbols, ends = repair(ids, last)
    count, at, n = Counter(), -2, symbols.tolist()
    for i in range(len(n) - 1):
        if not ends[i] and not (n[i] == n[i + 1] and i > 0 and n[i - 1] == n[i] and not ends[i - 1] and at == i - 1):
            count[n[i], n[i + 1]] += 1
            at = i
    assert max(count.values()) < PHASES[-1]
    assert len(symbols) + 3 * len(rules) < 0.8 * len(ids)
    assert (expand(symbols, rules, sizes) == ids).all()


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    ids = np.tile(rng.integers(0, 40, 500).astype(np.uint32), 20)
    ids[:200] = 7  # a run of one id
    last = np.zeros(len(ids), bool)
    last[99::100] = True
    rules, sizes, symbols, ends = repair(ids, last)
    assert (expand(symbols, rules, sizes) == ids).all() and len(symbols) < len(ids) / 4 and ends.sum() == last.sum()
    for k in range(len(rules)):
        assert len(expand(np.array([50_257 + k], np.uint32), rules, sizes)) == sizes[k]
    for a, n in ((0, 1), (5, 77), (150, 400), (9990, 10)):
        assert (slice_of(symbols, rules, sizes, a, n) == ids[a : a + n]).all()


@pytest.mark.parametrize("which", ["hard", "small", "empty"])
def test_files_round_trip(spark, enc, hard, empty, which):
    docs = {"hard": hard, "small": table(spark, SF, "documents"), "empty": empty}[which]
    path = scratch(spark, "tokens")
    write_tokens(docs, path, shard_tokens=20_000)
    got = sorted(map(tuple, read_tokens(spark, path).collect()), key=lambda r: r[1])
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, at = [], 0
    for doc_id, text in rows:
        x = ids_of(enc, text, 2)
        want.append((doc_id, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert got == want
    for row in spark.read.schema(FILE).parquet(path).limit(2).collect():
        row = row.asDict()
        doc_ids, n, ids = documents_of(row)
        for k in {0, len(doc_ids) // 2, len(doc_ids) - 1}:
            a = int(n[:k].sum())
            assert (read_document(row, k) == ids[a : a + n[k]]).all()
            assert (read_document(row, k, n[k] // 3, 1 + n[k] // 4) == ids[a + n[k] // 3 : a + n[k] // 3 + 1 + n[k] // 4]).all()
