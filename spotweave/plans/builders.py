"""Pair builders: raw text and table exports composed into the two matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spotweave.operators import features, prep
from spotweave.sources import readers


def regional_reference(
    spark: SparkSession, regions: dict[str, dict[str, str]]
) -> tuple[DataFrame, DataFrame]:
    """``(counts, obs)`` of a reference measured in parts.

    ``regions[tag]`` names the files ``exon``, ``intron`` (features x rows), ``rows``
    (feature keys and symbols) and ``samples`` (row id first, a ``cluster`` column).
    Exon and intron counts add up; the key column is found by its overlap; rows
    without a usable label are dropped; ids carry the tag.
    """
    all_counts, all_obs = [], []
    for tag, paths in regions.items():
        counts = readers.read_aligned_sum(spark, [paths["exon"], paths["intron"]])
        lookup = readers.read_csv_rows(spark, paths["rows"])
        symbol = "gene_symbol" if "gene_symbol" in lookup.columns else "gene"
        keys = counts.select(F.col("feature").alias("key")).distinct()
        column, _ = features.best_key_column(keys, lookup)
        counts = features.translate_keys(counts, lookup, column, symbol)
        samples = readers.read_csv_rows(spark, paths["samples"])
        named = F.concat(F.lit(f"{tag}_"), F.col(samples.columns[0]))
        all_obs.append(samples.select(named.alias("obs_id"), F.col("cluster").alias("label"), F.lit(tag).alias("region")))
        all_counts.append(counts.withColumn("obs_id", F.concat(F.lit(f"{tag}_"), F.col("obs_id"))))
    obs = all_obs[0]
    for part in all_obs[1:]:
        obs = obs.unionByName(part)
    obs = prep.drop_bad_labels(obs, "label")
    counts = features.collapse_features(features.outer_concat(all_counts))
    return counts.join(obs.select("obs_id"), "obs_id", "left_semi"), obs


def annotated_reference(
    counts: DataFrame, obs: DataFrame, annotation: DataFrame, key: str, label: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(counts, obs, missing)`` of the annotated rows; ``missing`` counts annotations
    without a row."""
    kept, missing = prep.annotated_rows(obs, annotation, key)
    labelled = prep.attach_labels(kept, annotation, key, label)
    inside = counts.join(kept.select("obs_id"), "obs_id", "left_semi")
    return features.collapse_features(inside), labelled, missing


def tiled_spatial(
    counts: DataFrame, cells: DataFrame, tile: str, region: tuple[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(counts, obs)`` of spots measured in tiles with local coordinates ``px, py``;
    tiles are laid out side by side, optionally for one region only."""
    if region is not None:
        cells = prep.keep_region(cells, *region)
    placed = prep.grid_offset(cells, tile).withColumn("px", F.col("gx")).withColumn("py", F.col("gy"))
    inside = counts.join(cells.select("obs_id"), "obs_id", "left_semi")
    return features.collapse_features(inside), placed.drop("gx", "gy")


def panel_spatial(
    counts: DataFrame, var: DataFrame, obs: DataFrame, cells: DataFrame, key: str, x: str, y: str
) -> tuple[DataFrame, DataFrame]:
    """``(counts, obs)`` of a panel measurement: gene features only, and a centroid for
    every row (a row without one is an error)."""
    genes = readers.keep_feature_type(var)
    kept = counts.join(genes.select("feature"), "feature", "left_semi")
    return features.collapse_features(kept), prep.attach_coordinates(obs, cells, key, x, y)
