"""Sinks: matrices, run outputs and the cached reference scaffold."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from spotweave.sources import files

SCAFFOLD_VERSION = 1


def write_matrix(counts: DataFrame, obs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes a matrix; rows of one ``obs_id`` lie together for cheap windows later."""
    counts.repartition("obs_id").sortWithinPartitions("obs_id").write.mode(mode).parquet(f"{path}/counts")
    obs.write.mode(mode).parquet(f"{path}/obs")
    counts.select("feature").distinct().write.mode(mode).parquet(f"{path}/var")


def write_start_clustering(start: DataFrame, n_clusters: int, path: str) -> None:
    """``(obs_id, c, name)``; every cluster must have exactly one name."""
    names = start.select("c", "name").distinct()
    if names.count() != n_clusters:
        raise ValueError(f"expected {n_clusters} cluster names")
    start.write.mode("overwrite").parquet(f"{path}/start_clustering")


# Tables of a few rows per K: one file per K is enough.
SMALL_TABLES = {
    "cut",
    "onehot_summary",
    "confidence_summary",
    "topology",
    "coherence",
    "coherence_summary",
    "cossim_summary",
    "modularity",
}


def write_by_k(df: DataFrame, run: str, table: str) -> None:
    """Writes a per-K table as one folder per K; only the K values written are replaced."""
    # Row tables are spread by K and row hash: a task writes few folders, and one K is
    # still written by many tasks.
    wide = df.repartition("k") if table in SMALL_TABLES else df.repartition("k", F.pmod(F.xxhash64(*df.columns), F.lit(256)))
    wide.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("k").parquet(
        f"{run}/{table}"
    )


def drop_by_k(spark: SparkSession, run: str, table: str) -> None:
    """Empties a table an earlier run with this name may have left."""
    if files.exists(spark, f"{run}/{table}"):
        old = spark.read.parquet(f"{run}/{table}")
        spark.createDataFrame([], old.schema).write.mode("overwrite").parquet(f"{run}/{table}")


def write_config(spark: SparkSession, run: str, config: dict) -> None:
    files.write_json(spark, f"{run}/config", config)


def tsv_to_csv(spark: SparkSession, source: str, target: str) -> None:
    spark.read.option("header", True).option("sep", "\t").csv(source).write.mode("overwrite").option(
        "header", True
    ).csv(target)


def feature_digest(features: DataFrame) -> str:
    """sha256 of the sorted feature names, joined by NUL."""
    return features.agg(
        F.sha2(F.array_join(F.array_sort(F.collect_set("feature")), "\0"), 256).alias("h")
    ).first()["h"]


def scaffold_key(
    spark: SparkSession,
    sc_path: str,
    st_path: str,
    features: DataFrame,
    resolution: float,
    annotation: str | None,
) -> dict:
    return {
        "version": SCAFFOLD_VERSION,
        "sc": files.stamp(spark, sc_path),
        "st": files.stamp(spark, st_path),
        "features": feature_digest(features),
        "resolution": resolution,
        "annotation": annotation,
    }


def _scaffold_folder(out: str, key: dict) -> str:
    digest = hashlib.sha256(json.dumps(key, sort_keys=True).encode()).hexdigest()
    return f"{out}/scaffold/{digest[:16]}"


def write_scaffold(spark: SparkSession, out: str, tables: dict[str, DataFrame], key: dict) -> None:
    """Writes the tables, then the key. A folder belongs to one key and counts only once
    its key is there, so a reader never sees half a scaffold."""
    folder = _scaffold_folder(out, key)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    files.write_json(spark, f"{folder}/key", {"key": key, "tables": sorted(tables)})


def read_scaffold(spark: SparkSession, out: str, key: dict) -> dict[str, DataFrame] | None:
    """The cached tables, or None when they are absent, of another key or unreadable."""
    folder = _scaffold_folder(out, key)
    meta = files.read_json(spark, f"{folder}/key")
    if not meta or meta.get("key") != key:
        return None
    try:
        return {name: spark.read.parquet(f"{folder}/{name}") for name in meta["tables"]}
    except AnalysisException:
        return None
