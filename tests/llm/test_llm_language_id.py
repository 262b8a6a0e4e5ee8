import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm.common import table
from tessera.llm import language_id as L
from tessera.llm.language_id import fit, identify, keep_identified

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_contract(spark):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: r for r in identify(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(got) == len(rows)
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 for r in got.values())
    held = [r for r in rows if got[r.doc_id].held_out and got[r.doc_id].lang_pred != "und"]
    right = sum(got[r.doc_id].lang_pred == r.lang for r in held)
    print(right / len(held))
    assert right / len(held) > 0.97
    # Calibration: the mean score is near the share of right answers.
    assert abs(sum(got[r.doc_id].score for r in held) / len(held) - right / len(held)) < 0.05


def test_hard_rows(hard, empty):
    got = {r.doc_id: r for r in identify(hard).collect()}
    assert identify(hard).count() == 10
    for i in (2, 3, 7, 8):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[6].lang_pred != "und"
    assert identify(empty).count() == 0
    assert keep_identified(hard, 0.0).columns == hard.columns


def test_nothing_to_learn_from(spark, hard):
    from pyspark.sql import functions as F

    got = identify(hard.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


def test_lang_is_no_input(spark):
    from pyspark.sql import functions as F

    docs = table(spark, SF, "documents").limit(200)
    model = fit(docs)
    a = sorted(map(tuple, identify(docs, model).collect()))
    b = sorted(map(tuple, identify(docs.withColumn("lang", F.lit("xx")), model).collect()))
    assert a == b


def test_slots_equal_a_dictionary():
    for text in ("", "a", "Ab", "abcabc é日😀 x" * 9, "A\u0130B"):
        want = Counter()
        chars = [ord(c) for c in text.lower()]
        for n in (1, 2, 3):
            for i in range(len(chars) - n + 1):
                h = 0
                for c in chars[i : i + n]:
                    h = (h * 2246822519 + c * 2654435761) & 0xFFFFFFFF
                    h ^= h >> 15
                want[(h * 3266489917 & 0xFFFFFFFF) >> 17] += 1
        at, count = L.slots_of(text)
        assert dict(zip(at.tolist(), count.tolist())) == want


def test_training_equals_a_scalar_ftrl(monkeypatch):
    """FTRL-proximal with elastic net by dictionaries, one weight at a time."""
    monkeypatch.setattr(L, "DIMENSIONS", 64)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(30):
        at = np.sort(rng.choice(64, 8, replace=False))
        rows.append((at, rng.integers(1, 5, 8), "xyz"[i % 3]))
    df = np.bincount(np.concatenate([r[0] for r in rows]), minlength=64)
    model = L.train(rows, df, 30)
    idf = [math.log(31 / (1 + f)) + 1 for f in df]

    def vector(at, n):
        x = {int(a): (1 + math.log(c)) * idf[a] for a, c in zip(at, n)}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {a: v / size for a, v in x.items()}

    data = [(vector(a, n), "xyz".index(k)) for a, n, k in rows]
    fit_rows = [d for i, d in enumerate(data) if i % 5]
    z, g2 = {}, {}

    def weight(a, k):
        v = z.get((a, k), 0.0)
        if abs(v) <= L.L1:
            return 0.0
        return -(v - math.copysign(L.L1, v)) / ((L.BETA + math.sqrt(g2.get((a, k), 0.0))) / L.ALPHA + L.L2)

    order = np.random.default_rng(0)
    for _ in range(L.EPOCHS):
        for i in order.permutation(len(fit_rows)):
            x, label = fit_rows[i]
            x = {**x, 64: 0.3}
            w = {(a, k): weight(a, k) for a in x for k in range(3)}
            s = [sum(v * w[a, k] for a, v in x.items()) for k in range(3)]
            e = [math.exp(v - max(s)) for v in s]
            for k in range(3):
                err = e[k] / sum(e) - (k == label)
                for a, v in x.items():
                    g, old = v * err, g2.get((a, k), 0.0)
                    g2[a, k] = old + g * g
                    z[a, k] = z.get((a, k), 0.0) + g - (math.sqrt(g2[a, k]) - math.sqrt(old)) / L.ALPHA * w[a, k]
    want = np.array([[weight(a, k) * (0.3 if a == 64 else 1) for k in range(3)] for a in range(65)])
    assert np.allclose(model.weights, want, atol=1e-10)
    held = data[::5]

    def loss(t):
        total = 0.0
        for x, label in held:
            s = [(sum(v * want[a, k] for a, v in x.items()) + want[64, k]) / t for k in range(3)]
            total -= math.log(math.exp(s[label]) / sum(map(math.exp, s)) + 1e-12)
        return total

    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    assert model.temperature == pytest.approx(min(grid, key=loss))


def test_the_sample_is_bounded_and_repeats_count_once(spark):
    from pyspark.sql import functions as F

    ids = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("word "), (F.col("id") % 50_000).cast("string")).alias("text"))
    same = spark.range(20_000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("de").alias("lang"), F.lit("der hund").alias("text"))
    seen = []
    real = L.train
    try:
        L.train = lambda rows, *a: seen.append(rows) or real(rows, *a)
        fit(ids.unionByName(same))
    finally:
        L.train = real
    count = Counter(r[2] for r in seen[0])
    assert 600 < count["en"] < 1000 and count["de"] == 1


def test_too_many_languages_raise(spark):
    from pyspark.sql import functions as F

    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("lang"), F.lit("text").alias("text"))
    with pytest.raises(ValueError, match="languages"):
        fit(many)
