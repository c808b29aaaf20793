"""Feature-set operators: intersection, difference, union, collapse, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def feature_set(counts: DataFrame) -> DataFrame:
    return counts.select("feature").distinct()


def shared_features(left: DataFrame, right: DataFrame) -> DataFrame:
    """Features present in both matrices."""
    return feature_set(left).join(feature_set(right), "feature", "left_semi")


def only_left_features(left: DataFrame, right: DataFrame) -> DataFrame:
    return feature_set(left).join(feature_set(right), "feature", "left_anti")


def union_features(chosen: DataFrame, always: DataFrame) -> DataFrame:
    """The chosen features plus those that must stay, once each."""
    return chosen.select("feature").unionByName(always.select("feature")).distinct()


def collapse_features(counts: DataFrame) -> DataFrame:
    """Upper-cases feature names and sums the columns that collide."""
    return counts.groupBy("obs_id", F.upper("feature").alias("feature")).agg(F.sum("x").alias("x"))


def outer_concat(parts: list[DataFrame]) -> DataFrame:
    """Rows of several matrices below each other; an absent value is 0 in long form."""
    out = parts[0].select("obs_id", "feature", "x")
    for part in parts[1:]:
        out = out.unionByName(part.select("obs_id", "feature", "x"))
    return out


def sum_aligned(parts: list[DataFrame]) -> DataFrame:
    """Element-wise sum of matrices over the same rows and columns."""
    return outer_concat(parts).groupBy("obs_id", "feature").agg(F.sum("x").alias("x"))


def same_ids(left: DataFrame, right: DataFrame) -> bool:
    """True when both frames hold the same set of ``obs_id``."""
    a, b = left.select("obs_id").distinct(), right.select("obs_id").distinct()
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def align(measured: DataFrame, predicted: DataFrame) -> DataFrame:
    """``(obs_id, feature, x, pred)`` of two matrices over the same rows.

    Raises when no feature is shared or the row sets differ. A cell absent on one
    side is 0, so the join keeps both sides.
    """
    shared = shared_features(measured, predicted)
    if shared.isEmpty():
        raise ValueError("the matrices share no feature")
    if not same_ids(measured, predicted):
        raise ValueError("the matrices cover different rows")
    left = measured.join(shared, "feature", "left_semi").select("obs_id", "feature", "x")
    right = predicted.join(shared, "feature", "left_semi").select(
        "obs_id", "feature", F.col("x").alias("pred")
    )
    return left.join(right, ["obs_id", "feature"], "full_outer").na.fill(0.0, ["x", "pred"])


def best_key_column(keys: DataFrame, lookup: DataFrame, key: str = "key") -> tuple[str, float]:
    """Lookup column matching the largest share of ``keys`` (first wins on a tie).

    All columns are stacked and meet the keys in one join; a number per column comes back.
    """
    wanted = keys.groupBy(F.col(key).cast("string").alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    total = wanted.agg(F.sum("_n")).first()[0] or 0
    stacked = F.array(*(F.struct(F.lit(i).alias("at"), F.col(c).cast("string").alias("_k")) for i, c in enumerate(lookup.columns)))
    have = lookup.select(F.inline(stacked)).distinct()
    found = {r["at"]: r["n"] for r in have.join(wanted, "_k").groupBy("at").agg(F.sum("_n").alias("n")).collect()}
    ratios = [found.get(i, 0) / total if total else 0.0 for i in range(len(lookup.columns))]
    best = max(range(len(ratios)), key=lambda i: (ratios[i], -i))
    return lookup.columns[best], ratios[best]


def translate_keys(
    counts: DataFrame, lookup: DataFrame, key_column: str, symbol_column: str
) -> DataFrame:
    """Replaces feature keys by their symbol; a key without an entry stays as it is."""
    names = (
        lookup.select(
            F.col(key_column).cast("string").alias("feature"),
            F.col(symbol_column).cast("string").alias("_symbol"),
        )
        .groupBy("feature")
        .agg(F.last("_symbol").alias("_symbol"))
    )
    return (
        counts.join(names, "feature", "left")
        .withColumn("feature", F.coalesce("_symbol", "feature"))
        .drop("_symbol")
    )
