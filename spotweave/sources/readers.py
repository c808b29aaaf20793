"""Scans: matrices, coordinates, wide text tables, index files, run outputs.

A matrix on disk is a folder ``<name>/`` with Parquet tables ``counts`` (obs_id,
feature, x), ``obs`` (obs_id, labels, px, py) and optionally ``var`` (feature).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from spotweave.operators.kselect import fill_missing
from spotweave.sources import files

# Fixed order in which the mappers are listed.
MAPPER_ORDER = ("nearest_centroid", "wann", "tangram", "tacco", "dot")


@dataclass(frozen=True)
class Matrix:
    """A lazily scanned matrix: its cells, its rows and its columns."""

    counts: DataFrame
    obs: DataFrame
    var: DataFrame
    path: str = ""


def read_matrix(spark: SparkSession, path: str) -> Matrix:
    counts = spark.read.parquet(f"{path}/counts")
    obs = spark.read.parquet(f"{path}/obs")
    try:
        var = spark.read.parquet(f"{path}/var").select("feature")
    except AnalysisException:
        var = counts.select("feature").distinct()
    return Matrix(counts.select("obs_id", "feature", F.col("x").cast("double").alias("x")), obs, var, str(path))


def obs_columns(spark: SparkSession, path: str) -> list[str]:
    """Annotation columns of a matrix; reads the file footer only."""
    return [c for c in spark.read.parquet(f"{path}/obs").columns if c not in ("obs_id", "px", "py")]


def coordinates(spark: SparkSession, path: str) -> DataFrame | None:
    """``(obs_id, px, py)``, or None for a matrix without coordinates."""
    obs = spark.read.parquet(f"{path}/obs")
    if not {"px", "py"} <= set(obs.columns):
        return None
    return obs.select("obs_id", "px", "py")


def shared_feature_list(spark: SparkSession, sc_path: str, st_path: str) -> DataFrame:
    """Shared features of two matrices on disk, without reading a count."""
    a, b = read_matrix(spark, sc_path).var, read_matrix(spark, st_path).var
    return a.distinct().join(b.distinct(), "feature", "left_semi")


def read_csv_rows(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV with a header, every cell as text (plain or gzip)."""
    return spark.read.option("header", True).option("sep", sep).csv(path)


def read_index(spark: SparkSession, folder: str) -> DataFrame | None:
    """``index.csv`` of a data folder, blanks as '', or None when there is none."""
    try:
        table = read_csv_rows(spark, f"{folder}/index.csv")
    except AnalysisException:
        return None
    return table.na.fill("") if "Name" in table.columns else None


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``pairs.csv``; raises when a required column is missing."""
    table = read_csv_rows(spark, path).na.fill("")
    missing = sorted({"PairID", "scName", "stName"} - set(table.columns))
    if missing:
        raise ValueError(f"{path} lacks column(s) {missing}")
    return table


def unpivot_wide(wide: DataFrame, id_column: str, id_name: str, column_name: str) -> DataFrame:
    """A wide table as ``(id_name, column_name, x)`` without zeros.

    The columns are zipped with their names inside each row, so one row yields its
    cells without a shuffle.
    """
    values = [c for c in wide.columns if c != id_column]
    cells = F.arrays_zip(
        F.array(*[F.lit(v) for v in values]).alias("name"),
        F.array(*[F.expr(f"try_cast(`{v}` AS DOUBLE)") for v in values]).alias("x"),
    )
    return (
        wide.select(F.col(id_column).alias(id_name), F.explode(cells).alias("e"))
        .select(id_name, F.col("e.name").alias(column_name), F.col("e.x").alias("x"))
        .where("x IS NOT NULL AND x <> 0")
    )


def read_genes_by_cells(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A features x rows text table as long counts (the transpose is free in long form)."""
    wide = read_csv_rows(spark, path, sep)
    return unpivot_wide(wide, wide.columns[0], "feature", "obs_id").select("obs_id", "feature", "x")


def read_aligned_sum(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Cell-wise sum of aligned features x rows tables, scanned in parallel splits."""
    out = None
    for path in paths:
        part = read_genes_by_cells(spark, path)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("obs_id", "feature").agg(F.sum("x").alias("x"))


def keep_feature_type(features: DataFrame, wanted: str = "Gene Expression") -> DataFrame:
    """Columns of one feature type; all of them when no type is recorded."""
    if "feature_types" not in features.columns:
        return features
    return features.where(F.col("feature_types") == wanted)


def run_folder(out: str, mapper: str) -> str:
    return f"{out}/{mapper}"


def is_run(spark: SparkSession, path: str) -> bool:
    return files.exists(spark, f"{path}/config") or files.exists(spark, f"{path}/mapping")


def list_mappers(spark: SparkSession, out: str) -> list[str]:
    """Mappers with a run under ``out``, in their fixed order, then custom ones."""
    present = {p for p in files.folders(spark, out) if is_run(spark, f"{out}/{p}")}
    return [m for m in MAPPER_ORDER if m in present] + sorted(present - set(MAPPER_ORDER))


def list_ks(spark: SparkSession, run: str) -> list[int]:
    """K values of a run, from the names of its partition folders."""
    names = files.folders(spark, f"{run}/assignment")
    return sorted(int(n[2:]) for n in names if n.startswith("k=") and n[2:].isdigit())


def all_ks(spark: SparkSession, out: str) -> list[int]:
    """K values of all runs under ``out``."""
    return sorted({k for m in list_mappers(spark, out) for k in list_ks(spark, run_folder(out, m))})


def read_k(spark: SparkSession, run: str, table: str, k: int) -> DataFrame:
    """One K of a run table; only its partition folder is read."""
    return spark.read.parquet(f"{run}/{table}").where(F.col("k") == k)


def read_mapping(spark: SparkSession, run: str, k: int) -> tuple[DataFrame, DataFrame]:
    """``(mapping, assignment)`` of one K: weights, and hard state with confidence."""
    return read_k(spark, run, "mapping", k), read_k(spark, run, "assignment", k)


def read_k_table(spark: SparkSession, run: str) -> DataFrame | None:
    """The K table, its late columns filled from the per-K tables where it lacks them."""
    try:
        table = spark.read.parquet(f"{run}/k_comparison")
    except AnalysisException:
        return None
    late = {
        "modularity": {"modularity_st_expression": "modularity_st_expression"},
        "cossim_summary": {
            "cossim_hard_raw_spot_null": "median_spot_null",
            "cossim_hard_raw_gene_null": "median_gene_null",
        },
    }
    for source, columns in late.items():
        absent = {new: old for new, old in columns.items() if new not in table.columns}
        if not absent:
            continue
        try:
            lookup = spark.read.parquet(f"{run}/{source}")
        except AnalysisException:
            lookup = table.select("k")
        if "combo" in lookup.columns:
            lookup = lookup.where(F.col("combo") == "hard-raw")
        have = [F.col(old).alias(new) for new, old in absent.items() if old in lookup.columns]
        table = fill_missing(table, lookup.select("k", *have), list(absent))
    return table


def read_config(spark: SparkSession, run: str) -> dict:
    """Settings a run was made with; empty when none were kept."""
    return files.read_json(spark, f"{run}/config") or {}
