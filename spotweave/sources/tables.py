"""The given star-schema tables posed as matrices.

Reference rows are customers, spatial rows are suppliers placed by nation and account
balance; the features are brands with summed quantities, plus order priorities on
the reference side and return flags on the spatial side, which are not shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _features(private: str) -> Column:
    return F.explode(
        F.array(
            F.struct(F.upper("p_brand").alias("feature"), F.col("l_quantity").alias("x")),
            F.struct(F.col(private).alias("feature"), F.lit(1.0).alias("x")),
        )
    ).alias("e")


def customer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .join(orders, lines.l_orderkey == orders.o_orderkey)
        .select(F.col("o_custkey").alias("obs_id"), _features("o_orderpriority"))
        .groupBy("obs_id", F.col("e.feature").alias("feature"))
        .agg(F.sum("e.x").alias("x"))
    )


def supplier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_returnflag")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .select(F.col("l_suppkey").alias("obs_id"), _features("l_returnflag"))
        .groupBy("obs_id", F.col("e.feature").alias("feature"))
        .agg(F.sum("e.x").alias("x"))
    )


def customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(obs_id, label, segment)``: the nation and the market segment as annotations."""
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation")
    return customers.join(nations, customers.c_nationkey == nations.n_nationkey, "left").select(
        F.col("c_custkey").alias("obs_id"), F.col("n_name").alias("label"), F.col("c_mktsegment").alias("segment")
    )


def supplier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("obs_id"),
        F.col("s_nationkey").cast("double").alias("px"),
        F.col("s_acctbal").alias("py"),
    )


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("obs_id"), F.col("event_type").alias("feature"))
        .agg(F.count(F.lit(1)).cast("double").alias("x"))
    )


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(obs_id, vec, c)``: the vectors with their label as start cluster."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("obs_id"),
        F.col("embedding").cast("array<double>").alias("vec"),
        F.col("label").alias("c"),
    )
