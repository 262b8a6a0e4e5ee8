import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.byte_bpe import Encoder
from tessera.llm.common import table
from tessera.llm.language_id import fit
from tessera.llm.pii import redact

from .conftest import SF
from .test_llm_exact_dedup import brute as exact
from .test_llm_near_copies import brute as near
from .test_llm_pii import base


def kept(spark):
    """Texts of the documents that language, exact and near stages keep, by brute force."""
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    model = fit(docs)
    keep = {i for i, r in rows.items() if (lambda x: x[0] != "und" and x[1] >= model.least)(model.predict(r.text))}
    assert len(keep) > 0.9 * len(rows)
    keep = {i for i, k, *_ in exact([(i, rows[i].text) for i in keep]) if i == k}
    keep = near([(i, rows[i].text) for i in keep])
    return {i: rows[i] for i in keep}


def plainly(text):
    """The text without personal data of the base kinds; also whether other kinds may be there."""
    spans = sorted((int(a), -int(b), k) for k, a, b in (s.split(":") for s in base(text)))
    out, at = "", 0
    for a, b, k in spans:
        if a >= at:
            out += text[at:a] + f"[{k.upper()}]"
        at = max(at, -b)
    return out + text[at:]


def test_against_brute_force(spark):
    rows = kept(spark)
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert set(got["doc_id"]) == set(rows)
    enc, plain = Encoder(), 0
    redacted = {r.doc_id: r.text for r in redact(spark.createDataFrame([tuple(r) for r in rows.values()], table(spark, SF, "documents").schema)).collect()}
    for i, r in rows.items():
        plain += redacted[i] == plainly(r.text)
        ids = np.array([*enc.whole.encode(redacted[i], add_special_tokens=False).ids, 1], np.uint32)
        mine = got[got["doc_id"] == i].sort_values("start")
        assert set(mine["doc_tokens"]) == {len(ids)}
        at = 0
        for p in mine.itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert plain > 0.9 * len(rows)  # the others hold personal data of the added kinds
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_keep_all_columns(spark, hard, empty):
    """Rows of trouble and clashing names go through every stage, in order and by themselves."""
    names = ["__row", "row", "__k_id", "__k_doc_id", "__text", "__m_email", "__spans", "id", "stays", "node", "keys", "root", "k", "h", "least"]
    docs = hard.withColumns({c: F.lit("own") for c in names})
    chain = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs, chain):
            got = stage(spark, rows, SF)
            assert got.schema.names == docs.schema.names, name
            assert {r["__row"] for r in got.collect()} <= {"own"}
        assert stage(spark, empty, SF).count() == 0, name
        chain = stage(spark, chain, SF).cache()
    last = corpus_pipeline.packing_stage
    assert {r.doc_id for r in last(spark, docs, SF).collect()} == {1, 2, 3, 4, 5, 6, 7, 8, None}
    assert {r.doc_id for r in last(spark, chain, SF).collect()} == {r.doc_id for r in chain.collect()}
    assert last(spark, empty, SF).count() == 0


def test_each_stage_decides_as_stated(spark, hard):
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    everyone = ids(hard)
    assert ids(corpus_pipeline.language_stage(spark, hard, SF)) == sorted([i for i in everyone if i not in (2, 3, 7, 8)], key=str)
    assert ids(corpus_pipeline.exact_stage(spark, hard, SF)) == sorted([1, 2, 5, 6, 7, None], key=str)
    assert ids(corpus_pipeline.near_stage(spark, hard, SF)) == sorted([1, 2, 5, 6, None], key=str)
    assert ids(corpus_pipeline.pii_stage(spark, hard, SF)) == everyone
