"""Personal data in texts, by Spark's own functions only.

Regular expressions propose spans; validators confirm them (Luhn for cards, mod 97
for IBANs, the range of parts for addresses, digit counts); context words within
``NEAR`` code points of a span adjust its score. Base kinds (email, ip, card, phone)
are reported whenever their validator passes; the kinds that the method adds (iban,
ssn) need a score of ``LEAST``, so an ssn-like number counts only near such a word.
The country code fixes how long an IBAN is, so what follows it is never taken in.

Positions: ``split`` gives the gaps between the matches that ``regexp_extract_all``
gives, so starts are prefix sums of their lengths in code points. Prefix sums are
made in blocks, so a text with very many matches costs far less than the square.
Patterns are those of the contract with possessive loops, which match the same and
neither backtrack nor recurse; email and ip start at the beginning of a run of
their characters or where the last match ended, so long runs are read once.

Plan: a projection over the scan; no shuffle, no Python. Memory: one text.

Defined results: null = empty text = no spans; a null doc_id is kept as null; a very long
text is searched as a whole; empty table = no rows; repeated rows give repeated rows;
extra columns, whatever their names, are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

NEAR, LEAST = 40, 0.5
BLOCK = 64
#: So many matches of a kind, with the text up to the next, cover ``NEAR`` code points.
REACH = NEAR // 2
#: Characters of an IBAN by its country code: the registry's, and those in use beside it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}+" for n, c in IBAN_LENGTHS.items())
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Score without context, and the words that add ``BONUS`` to it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
BONUS = 0.2
CONTEXT = {
    "email": r"(?i)e-?mail|contact|write to",
    "ip": r"(?i)\bip\b|address|host|server",
    "card": r"(?i)card|visa|credit|payment",
    "phone": r"(?i)phone|call|tel\b|mobile|fax",
    "iban": r"(?i)iban|bank|account|konto",
    "ssn": r"(?i)ssn|social security",
}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: every second digit from the right doubled."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1: its first four characters go to the
    end, letters are numbers from 10."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _part_fits(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return F.when(F.length(short) <= 3, short).otherwise("999").cast("int") <= 255


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), _part_fits)
    if kind == "card":
        d = _digits(match)
        return F.length(d).between(16, 19) & luhn(d)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    return F.lit(True)


def prefix_sums(lengths: Column) -> Column:
    """The sum of the elements before each element, in blocks."""
    blocks = F.transform(
        F.when(F.size(lengths) > 0, F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(BLOCK))).otherwise(F.array().cast("array<int>")),
        lambda i: F.slice(lengths, i + 1, F.lit(BLOCK)),
    )
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    before = F.aggregate(
        blocks,
        F.struct(F.array().cast("array<int>").alias("a"), F.lit(0).alias("s")),
        lambda acc, b: F.struct(F.concat(acc["a"], F.array(acc["s"])).alias("a"), (acc["s"] + total(b)).alias("s")),
        lambda acc: acc["a"],
    )
    within = lambda p: F.transform(p["b"], lambda x, j: p["s"] + total(F.slice(p["b"], F.lit(1), j)))
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), before.alias("s")), lambda p: within(p)))


def _spans(kind: str) -> tuple[Column, Column, Column, Column]:
    """Starts of one kind's matches, the text at their ends and beginnings, and its
    confirmed spans, from its columns of matches and gaps."""
    m, g = F.col(f"__m_{kind}"), F.col(f"__g_{kind}")
    gaps, own = F.transform(g, F.length), F.transform(m, F.length)
    # What ends with a match, and what begins with one, as far as it can be near another.
    n = F.size(m)
    tails = F.zip_with(F.slice(g, F.lit(1), n), m, lambda a, b: F.right(F.concat(a, b), F.lit(NEAR)))
    heads = F.zip_with(m, F.slice(g, F.lit(2), n), lambda a, b: F.left(F.concat(a, b), F.lit(NEAR)))
    steps = F.zip_with(gaps, F.concat(own, F.array(F.lit(0))), lambda a, b: a + b)
    starts = F.zip_with(prefix_sums(steps), gaps, lambda a, b: a + b)

    def span(match: Column, i: Column) -> Column:
        start = F.get(F.col(f"__s_{kind}"), i)
        first = F.greatest(i - REACH, F.lit(0))
        left = F.concat(F.array_join(F.slice(F.col(f"__t_{kind}"), first + 1, i - first), ""), F.get(g, i))
        right = F.concat(F.get(g, i + 1), F.array_join(F.slice(F.col(f"__h_{kind}"), i + 2, F.lit(REACH)), ""))
        near = F.concat(F.right(left, F.lit(NEAR)), F.lit("\n"), F.left(right, F.lit(NEAR)))
        score = F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(near.rlike(CONTEXT[kind]), F.lit(BONUS)).otherwise(F.lit(0.0)))
        fit = valid(kind, match) if kind in BASE else valid(kind, match) & (score >= LEAST)
        return F.when(fit, F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(match)).alias("end"), score.alias("score")))

    return starts, tails, heads, F.filter(F.transform(m, span), lambda s: s.isNotNull())


#: A character that every match of a kind contains, to skip texts without it.
_MUST = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with the column __spans: array of (kind, start, end, score), by kind as
    listed, then start."""
    df = docs.withColumn("__text", text_of())
    stages: dict[str, list] = {"m": [], "s": [], "f": []}
    for kind in KINDS:
        t, p = F.col("__text"), F.lit(PATTERNS[kind])
        if kind in _MUST:
            t = F.when(F.contains(t, F.lit(_MUST[kind])), t).otherwise(F.lit(""))
        stages["m"] += [F.regexp_extract_all(t, p, 0).alias(f"__m_{kind}"), F.split(t, PATTERNS[kind], -1).alias(f"__g_{kind}")]
        *parts, found = _spans(kind)
        stages["s"] += [F.when(F.size(f"__m_{kind}") > 0, c).alias(f"__{x}_{kind}") for x, c in zip("sth", parts, strict=True)]
        stages["f"].append(F.when(F.size(f"__m_{kind}") > 0, found).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")))
    df = df.select("*", *stages["m"]).select("*", *stages["s"])
    df = df.withColumn("__spans", F.concat(*stages["f"]))
    return df.drop(*[f"__{x}_{k}" for k in KINDS for x in "mgsth"])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores of every row."""
    df = with_spans(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    spans = F.col("__spans")
    is_kind = lambda k: lambda s: s["kind"] == k
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return df.select(
        "doc_id",
        *[F.size(F.filter(spans, is_kind(k))).cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(said(F.filter(spans, lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        said(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in brackets (overlapping spans by the
    first one's) and n_chars made anew where a text changed."""
    # The row goes along as one column, so none of its names can clash.
    df = with_spans(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"))
    chars = F.split("__text", "")
    cut = lambda a, n: F.array_join(F.slice(chars, a + 1, n), "")

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        more = F.concat(acc["out"], F.array(cut(acc["at"], F.greatest(s["start"] - acc["at"], F.lit(0))), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, more).otherwise(acc["out"]).alias("out"))

    by_start = F.array_sort("__spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), cut(acc["at"], F.greatest(F.length("__text") - acc["at"], F.lit(0))))
    changed = F.size("__spans") > 0
    df = df.withColumn("__new", F.when(changed, F.aggregate(by_start, first, step, rest)))
    own = lambda c: F.col("row").getField(c)
    out = {"text": F.coalesce(F.col("__new"), own("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(changed, F.length("__new").cast(docs.schema["n_chars"].dataType)).otherwise(own("n_chars"))
    return df.select(*[out.get(c, own(c)).alias(c) for c in docs.columns])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
