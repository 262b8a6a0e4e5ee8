import hashlib
import random
import re

import pytest

from tessera.llm.common import table
from tessera.llm.pii import find, redact

from .conftest import DOCUMENTS, SF

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if ok(k, m.group())]


def compare(docs):
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = find(docs).collect()
    for r in got:
        want = base(rows[r.doc_id])
        assert ",".join(s for s in r.spans.split(",") if s.split(":")[0] in BASE) == ",".join(want), (rows[r.doc_id] or "")[:300]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in BASE]
    return got


def test_documents(spark):
    got = compare(table(spark, "/root/testdata/sf0.01", "documents"))
    assert sum(r.n_email for r in got) > 5 and sum(r.n_card for r in got) > 5


def test_random_texts(spark):
    rng = random.Random(1)
    pieces = ["a.b", "@", "x-y.com", ".", "1.2.3.4", "999.1.1.1", " ", "4111 1111 1111 1111", "4111111111111111", "+", "+49 (30) 123-45.67", "_", "é", "😀", "0", "12", "-", "\n", "%", "a@b.c", "007.08.9.255"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    texts += ["a@b.c_d@e.f.g", "+1" * 300, "1 2 " * 20_000, "x" * 60_000 + "@", "1.2." * 3000, "a@b.co " * 500, "+12345678901234567", "a@b.c@d.e", "1.2.3.4.5.6.7.8"]
    compare(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))


def test_added_kinds_and_context(spark):
    texts = ["my IBAN is DE89 3704 0044 0532 0130 00.", "DE89370400440532013001", "ssn 123-45-6789", "part 123-45-6789", "card 4111 1111 1111 1111", "4111 1111 1111 1111"]
    got = {r.doc_id: r for r in find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got[0].spans.split(",")[-1] == "iban:11:38" and "iban" not in got[1].spans
    assert got[2].spans == "ssn:4:15" and got[3].spans == ""
    assert got[4].scores == "1.00" and got[5].scores == "0.80"


def test_hard_rows_and_redaction(spark, hard, empty):
    assert find(hard).count() == 10 and find(empty).count() == 0
    assert redact(hard).columns == hard.columns
    same = {(r.doc_id, r.text, r.n_chars) for r in redact(hard).collect()}
    assert same == {(r.doc_id, r.text, r.n_chars) for r in hard.collect()}
    rows = [(1, "é write a@b.co or +49 30 1234567, 10.0.0.1.", "en", "s", 9), (2, "4111111111111111@x.org", "en", "s", 9), (3, None, "en", "s", None)]
    got = {r.doc_id: r for r in redact(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    assert got[1].text == "é write [EMAIL] or [PHONE], [IP]." and got[1].n_chars == len(got[1].text)
    assert got[2].text == "[EMAIL]" and got[3].text is None


def test_no_python_in_the_plan(spark):
    plan = find(table(spark, SF, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
