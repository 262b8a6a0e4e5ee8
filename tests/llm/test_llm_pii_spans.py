from tessera.llm.pii import find, redact

from .conftest import DOCUMENTS


def spans(spark, texts):
    rows = find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    return [r.spans for r in sorted(rows, key=lambda r: r.doc_id)]


def test_iban_before_capitals_and_digits(spark):
    iban, spaced = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    texts = [f"IBAN {spaced} Please pay", f"pay {iban} Thanks", f"{iban} BIC COBADEFFXXX", f"pay {iban} 2024", f"{spaced} 2024", "NO9386011117947 AND GB82 WEST 1234 5698 7654 32 X"]
    got = [[s for s in x.split(",") if s.startswith("iban")] for x in spans(spark, texts)]
    assert got == [["iban:5:32"], ["iban:4:26"], ["iban:0:22"], ["iban:4:26"], ["iban:0:27"], ["iban:0:15", "iban:20:47"]]
    assert spans(spark, [f"{iban}X", f"X{iban}", "DE89370400440532013001 Thanks"]) == ["", "", ""]
    row = (1, texts[0], "en", "s", len(texts[0]))
    assert redact(spark.createDataFrame([row], DOCUMENTS)).first().text == "IBAN [IBAN] Please pay"


def test_context_reaches_over_other_matches(spark):
    numbers = ["123-45-6789", "987-65-4321", "111-22-3333"]
    near = "SSN " + " and ".join(numbers[:2])
    got = spans(spark, [near, "SSN " + ", ".join(numbers), ", ".join(numbers) + " (ssn)", "ssn" + " " * 38 + numbers[0], "ssn" + " " * 37 + numbers[0]])
    assert got == ["ssn:4:15,ssn:20:31", "ssn:4:15,ssn:17:28,ssn:30:41", "ssn:0:11,ssn:13:24,ssn:26:37", "", "ssn:40:51"]
    row = (1, near, "en", "s", len(near))
    assert redact(spark.createDataFrame([row], DOCUMENTS)).first().text == "SSN [SSN] and [SSN]"


def test_window_is_forty_code_points_of_the_text(spark):
    import random
    import re

    from tessera.llm.pii import BONUS, CONTEXT, NEAR, PRIOR

    rng = random.Random(4)
    pieces = ["call", "card", "ip", "mail", "a@b.co", "1.2.3.4", "4111111111111111", "+49 30 1234567", " ", ", ", "é😀", "xx"]
    texts = [" ".join(rng.choice(pieces) for _ in range(30)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in find(docs).collect():
        t = texts[r.doc_id]
        for span, score in zip(r.spans.split(","), r.scores.split(","), strict=True):
            k, a, b = span.split(":")
            near = t[max(0, int(a) - NEAR) : int(a)] + "\n" + t[int(b) : int(b) + NEAR]
            assert float(score) == round(min(1, PRIOR[k] + BONUS * bool(re.search(CONTEXT[k], near))), 2), (t, span)
