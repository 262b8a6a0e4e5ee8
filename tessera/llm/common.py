"""What the operators of this subpackage share: reading tables, checkpoints, Arrow maps."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the five ASCII controls \t\n\v\f\r.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see. The cluster names it in
    spark.checkpoint.dir; where that is unset a temporary folder of this machine is taken
    in local mode (tests), and anything else is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="tessera-checkpoint-")
    sc.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the rows are in the shared folder, so a lost executor costs
    nothing. Spark removes them when nothing refers to them any more only if
    spark.cleaner.referenceTracking.cleanCheckpoints is on; else they stay in the folder."""
    where = shared_dir(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a written table, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Keys of rows to drop or to fetch that may be broadcast: some 80 bytes each in memory.
KEYS = 500_000


def _by_list(docs: DataFrame, keys: dict[str, Column], listed: DataFrame, how: str) -> DataFrame:
    """docs joined with a list of keys, whose rows are counted first: few are broadcast, so
    that no text moves; more are joined by a shuffle, in which a text moves once. Null keys
    match nothing. Names of docs cannot clash, as its rows are joined as one column."""
    few = listed.limit(KEYS + 1).count() <= KEYS
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *[x.alias(f"__k_{k}") for k, x in keys.items()])
    listed = listed.select(*[F.col(k).alias(f"__k_{k}") for k in keys])
    left = rows.join(F.broadcast(listed) if few else listed, [f"__k_{k}" for k in keys], how)
    return left.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])


def without(docs: DataFrame, keys: dict[str, Column], gone: DataFrame) -> DataFrame:
    """docs without the rows whose keys are in gone, whose columns are the names of keys."""
    return _by_list(docs, keys, gone, "left_anti")


def only(docs: DataFrame, keys: dict[str, Column], wanted: DataFrame) -> DataFrame:
    """The rows of docs whose keys are in wanted, whose columns are the names of keys."""
    return _by_list(docs, keys, wanted, "left_semi")


def text_of(name: str = "text") -> Column:
    """The column, null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that what a task makes of one stays small; memory that a
    worker no longer needs goes back to the machine, as workers outlive their tasks."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def set_threads() -> None:
    """The tokenizer library must not start threads of its own in an executor's worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
