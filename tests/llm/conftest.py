import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


#: Nulls in every column, empty and long texts, ties, repeated rows.
HARD = [
    (1, "Plain words of a text", "en", "src0", 21),
    (2, None, None, None, None),
    (3, "", "en", "src0", 0),
    (4, "Plain  words\tof a\ntext", "en", "src1", 22),
    (4, "Plain  words\tof a\ntext", "en", "src1", 22),
    (5, "x" * 5000 + " " + "word " * 30_000, "en", "src0", 155_001),
    (6, "Ünïcode ß 日本語 😀 <|endoftext|> 12 345", None, "src2", 40),
    (None, "no id", "fr", None, None),
    (7, " ", "de", "src0", 1),
    (8, "\n\t ", "de", "src0", 3),
]


@pytest.fixture(scope="session")
def hard(spark):
    """Rows of trouble, with a column whose name the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(HARD, DOCUMENTS)
    return df.select("*", *[F.lit("own").alias(c) for c in ("digest", "size", "fingerprint", "shard", "spans", "start", "ids", "keep_id", "lang_pred")])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
