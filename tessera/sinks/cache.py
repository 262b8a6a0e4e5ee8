"""The feature cache: a Parquet table of keys, features and signals with a manifest.

Labels look ahead and are never written. The manifest has the columns, the number of
rows and a SHA-256 of the metadata that made the panel, so a cache of other settings
is not taken for this one. Table and manifest go through Spark, so the path may be in
any store that Spark reads.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .artifacts import plain

VERSION = 1
KEYS = ("date", "symbol")
#: How a panel's columns are told apart, by the start of their names.
ROLES = {
    "label": ("forward_return_",),
    "signal": ("momentum_signal_", "mean_reversion_signal_", "trend_signal_"),
    "filter": ("is_universe_eligible", "universe_"),
    "descriptor": ("classification_", "membership_", "trading_", "borrow_", "listing_", "delisting_"),
}


class CacheError(ValueError):
    """A cache is malformed, or is not that of the panel asked for."""


def role(column: str) -> str:
    """key, label, signal, filter, descriptor or feature."""
    if column in KEYS:
        return "key"
    return next((r for r, starts in ROLES.items() if column.startswith(starts)), "feature")


def feature_metadata(df: DataFrame) -> list[dict]:
    """Name, type and role of each column, in order."""
    return [{"column": c, "type": t, "role": role(c)} for c, t in df.dtypes]


def fingerprint(metadata: object) -> str:
    """SHA-256 of the canonical JSON: sorted keys, no spaces, NaN as null."""
    return hashlib.sha256(json.dumps(plain(metadata), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def write_cache(df: DataFrame, path: str, metadata: object, identify: Callable | None = None) -> dict:
    """Writes the table, then the manifest: a cache without one is incomplete. identify:
    columns -> what the manifest says of the plan behind them."""
    if missing := [k for k in KEYS if k not in df.columns]:
        raise CacheError(f"missing keys {missing}")
    kept = [c for c in df.columns if role(c) != "label"]
    spark = df.sparkSession
    df.select(*kept).write.mode("overwrite").parquet(f"{path}/table")
    rows, keys = spark.read.parquet(f"{path}/table").agg(F.count("*"), F.count_if(F.col("date").isNotNull() & F.col("symbol").isNotNull())).first()
    if rows != keys:
        raise CacheError(f"{rows - keys} rows without a key")
    manifest = {"schema_version": VERSION, "columns": kept, "row_count": rows, "fingerprint": fingerprint(metadata), "features": [m for m in feature_metadata(df) if m["column"] in kept]}
    if identify:
        manifest["plan"] = identify(kept)
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def load_manifest(spark: SparkSession, path: str) -> dict:
    lines = spark.read.text(f"{path}/manifest").limit(2).collect()
    if len(lines) != 1:
        raise CacheError(f"{path}: the manifest is not one line")
    manifest = json.loads(lines[0][0])
    if manifest.get("schema_version") != VERSION:
        raise CacheError(f"{path}: schema version {manifest.get('schema_version')}, not {VERSION}")
    return manifest


def load_cache(spark: SparkSession, path: str, metadata: object | None = None) -> DataFrame:
    """The table, if its columns, keys and number of rows are the manifest's and (with
    metadata) it was made by these settings."""
    manifest, df = load_manifest(spark, path), spark.read.parquet(f"{path}/table")
    if metadata is not None and fingerprint(metadata) != manifest["fingerprint"]:
        raise CacheError(f"{path}: made by other settings")
    if df.columns != manifest["columns"]:
        raise CacheError(f"{path}: columns differ from the manifest")
    if df.count() != manifest["row_count"]:
        raise CacheError(f"{path}: row count differs from the manifest")
    if df.groupBy(*KEYS).count().where("count > 1").limit(1).collect():
        raise CacheError(f"{path}: repeated keys")
    return df
