"""Scores of the cuts, their Pareto front and the proposed K.

The table has one row per K. Comparisons across rows use one array of its points, so
no row is paired with every other by a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from spotweave.functions.scalars import NAN, finite_or_nan, harmonic_mean, is_finite

NULL_SUFFIX = "_null"


@dataclass(frozen=True)
class Criterion:
    key: str
    label: str
    columns: tuple[str, str]
    scale_to_max: bool = False


# The measured curves behind each criterion.
CRITERIA = (
    Criterion("recon", "Reconstruction cossim", ("cossim_hard_raw_spot", "cossim_hard_raw_gene")),
    Criterion("spatial", "Spatial organisation", ("nhood_mean_self_zscore", "local_purity_zscore"), True),
    Criterion("coherence", "Transcriptional coherence", ("modularity_st_expression", "modularity_shared")),
)
METRIC_COLUMNS = (
    "cossim_hard_norm_spot",
    "cossim_hard_norm_gene",
    "cossim_hard_raw_spot",
    "cossim_hard_raw_gene",
    "cossim_hard_raw_spot_null",
    "cossim_hard_raw_gene_null",
    "nhood_mean_self_zscore",
    "local_purity_zscore",
    "modularity_shared",
    "modularity_st_expression",
    "mean_confidence",
)
# Criterion pairs drawn against each other.
def _column(table: DataFrame, name: str) -> Column:
    """The column as a double with NaN for missing values; all NaN when absent."""
    return finite_or_nan(f"`{name}`") if name in table.columns else F.lit(NAN)


def collect_metrics(ks: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """One row per K with every metric column; what no part delivers is NaN."""
    out = ks.select(F.col("k").cast("int").alias("k"))
    for part in parts:
        out = out.join(part, "k", "left")
    return out.select("k", *[_column(out, m).alias(m) for m in METRIC_COLUMNS]).orderBy("k")


def _scales(table: DataFrame, criterion: Criterion) -> list[Column]:
    """1 / largest finite value per curve; NaN unless that is positive."""
    if not criterion.scale_to_max:
        return [F.lit(1.0), F.lit(1.0)]
    out = []
    for name in criterion.columns:
        v = _column(table, name)
        top = table.agg(F.max(F.when(is_finite(v), v))).scalar()
        out.append(F.when(top > 0, F.try_divide(F.lit(1.0), top)).otherwise(F.lit(NAN)))
    return out


def scale_factors(table: DataFrame) -> DataFrame:
    """``(key, curve, factor)`` of every criterion's curves."""
    rows = None
    for c in CRITERIA:
        for name in c.columns:
            v = _column(table, name)
            top = F.max(F.when(is_finite(v), v))
            factor = (
                F.when(top > 0, F.try_divide(F.lit(1.0), top)).otherwise(F.lit(NAN))
                if c.scale_to_max
                else F.lit(1.0)
            )
            one = table.agg(factor.alias("factor")).select(
                F.lit(c.key).alias("key"), F.lit(name).alias("curve"), "factor"
            )
            rows = one if rows is None else rows.unionByName(one)
    return rows


def score_table(table: DataFrame) -> DataFrame:
    """``k`` and, per criterion, the combined score and its combined null."""
    cols = [F.col("k").cast("int").alias("k")]
    for c in CRITERIA:
        fa, fb = _scales(table, c)
        a, b = (_column(table, n) for n in c.columns)
        na, nb = (_column(table, n + NULL_SUFFIX) for n in c.columns)
        cols.append(harmonic_mean(a * fa, b * fb).alias(c.key))
        cols.append(harmonic_mean(na * fa, nb * fb).alias(c.key + NULL_SUFFIX))
    return table.select(*cols)


def overall(scores: DataFrame, keys: tuple[str, ...] | None = None) -> Column:
    """Harmonic mean over the criteria; NaN unless all are finite and positive."""
    keys = keys or tuple(c.key for c in CRITERIA)
    values = [_column(scores, k) for k in keys]
    good = F.lit(True)
    total = F.lit(0.0)
    for v in values:
        good = good & is_finite(v) & (v > 0)
        total = total + F.try_divide(F.lit(1.0), v)
    return F.when(good, F.try_divide(F.lit(float(len(keys))), total)).otherwise(F.lit(NAN))


def with_pareto(scores: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Adds ``pareto``: no other row is at least as good on all scores and better on one.

    A missing score is the worst value. Equal rows keep each other.
    """
    keys = keys or tuple(c.key for c in CRITERIA)
    low = F.lit(float("-inf"))

    def value(name: str) -> Column:
        v = _column(scores, name)
        return F.when(is_finite(v), v).otherwise(low)

    point = F.struct(*[value(k).alias(k) for k in keys])
    # The table's points, one per K, as a single value beside every row.
    points = scores.agg(F.collect_list(point)).scalar()

    def beats(p: Column) -> Column:
        all_ge, any_gt = F.lit(True), F.lit(False)
        for k in keys:
            all_ge = all_ge & (p[k] >= F.col("_own")[k])
            any_gt = any_gt | (p[k] > F.col("_own")[k])
        return all_ge & any_gt

    wide = scores.withColumn("_own", point).withColumn("_points", points)
    return wide.withColumn("pareto", ~F.exists("_points", beats)).drop("_own", "_points")


def score_metrics(table: DataFrame) -> DataFrame:
    """The metric table with one score per criterion, ``overall`` and ``pareto``."""
    scores = score_table(table)
    extra = with_pareto(scores.withColumn("overall", overall(scores))).select(
        "k", *[c.key for c in CRITERIA], "overall", "pareto"
    )
    return table.join(extra, "k").orderBy("k")


def best_ks(scored: DataFrame) -> DataFrame:
    """``(name, k, score)``: the best K overall and per criterion.

    Ties go to the smallest K; a criterion without a finite score has NULLs.
    """
    names = ["overall", *[c.key for c in CRITERIA]]
    aggs = []
    for name in names:
        v = _column(scored, name)
        best = F.max(F.when(is_finite(v), F.struct(v.alias("score"), (-F.col("k")).alias("neg"))))
        aggs.append(best.alias(name))
    row = scored.agg(*aggs)
    return row.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("name"),
                        (-F.col(n)["neg"]).cast("int").alias("k"),
                        F.col(n)["score"].alias("score"),
                    )
                    for n in names
                ]
            )
        ).alias("e")
    ).select("e.name", "e.k", "e.score")


def selection(scored: DataFrame) -> DataFrame:
    """One row, one JSON column: the Pareto Ks, the best Ks and the criteria."""
    best = best_ks(scored).agg(
        F.map_from_entries(
            F.collect_list(
                F.struct("name", F.when(F.col("k").isNotNull(), F.struct("k", "score")))
            )
        ).alias("best")
    )
    front = scored.agg(F.array_sort(F.collect_list(F.when(F.col("pareto"), F.col("k"))))).scalar()
    labels = F.create_map(*[F.lit(x) for c in CRITERIA for x in (c.key, c.label)])
    return best.select(
        F.to_json(
            F.struct(front.alias("pareto_ks"), "best", labels.alias("criteria")),
            {"ignoreNullFields": "false"},
        ).alias("json")
    )


def fill_missing(table: DataFrame, lookup: DataFrame, columns: list[str]) -> DataFrame:
    """Adds columns an older table lacks from a per-K lookup; present ones stay."""
    absent = [c for c in columns if c not in table.columns]
    if not absent:
        return table
    have = [c for c in absent if c in lookup.columns]
    out = table.join(lookup.select("k", *have), "k", "left")
    for c in absent:
        out = out.withColumn(c, _column(out, c))
    return out
