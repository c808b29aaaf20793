"""Data checks of count matrices, annotations, coordinates, pairs and index files.

A check yields rows ``(subject, check, severity, n, detail)``; an empty result means
it passed. Only aggregates move; no check collects data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spotweave.functions.scalars import safe_int

SCHEMA = "subject string, check string, severity string, n bigint, detail string"
# Fixed limits of the checks.
MIN_ROW_CV = 0.01
MIN_MAX_COUNT = 20
INTEGER_TOLERANCE = 1e-4
MIN_SHARED = 10


def _finding(df: DataFrame, when: Column, subject: str, check: str, severity: str, n: Column, detail: Column) -> DataFrame:
    return df.where(when).select(
        F.lit(subject).alias("subject"),
        F.lit(check).alias("check"),
        F.lit(severity).alias("severity"),
        n.cast("bigint").alias("n"),
        detail.cast("string").alias("detail"),
    )


def union_findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def check_features(var: DataFrame, subject: str) -> DataFrame:
    """Names that are not upper case, and names that occur twice. ``var(feature)`` has
    one row per column of the matrix."""
    upper = var.agg(
        F.count_if(F.col("feature") != F.upper("feature")).alias("n"),
        F.min(F.when(F.col("feature") != F.upper("feature"), F.col("feature"))).alias("eg"),
    )
    twice = (
        var.groupBy("feature")
        .count()
        .where("count > 1")
        .agg(F.count(F.lit(1)).alias("n"), F.min("feature").alias("eg"))
    )
    return union_findings(
        [
            _finding(upper, F.col("n") > 0, subject, "feature_case", "error", F.col("n"), F.col("eg")),
            _finding(twice, F.col("n") > 0, subject, "feature_duplicate", "error", F.col("n"), F.col("eg")),
        ]
    )


def count_statistics(counts: DataFrame, obs: DataFrame) -> DataFrame:
    """One row of the facts the count checks need; rows without counts are included.

    Missing, negative and non-integer values are counted over the whole matrix.
    """
    per_row = counts.groupBy("obs_id").agg(
        F.sum("x").alias("s"),
        F.max("x").alias("hi"),
        F.count_if(F.isnan("x") | F.col("x").isNull()).alias("bad"),
        F.count_if(F.col("x") < 0).alias("neg"),
        F.count_if(F.abs(F.col("x") - F.round("x")) > INTEGER_TOLERANCE).alias("frac"),
    )
    zero = F.lit(0)
    return (
        obs.select("obs_id")
        .join(per_row, "obs_id", "left")
        .agg(
            F.count(F.lit(1)).alias("n_obs"),
            F.avg(F.coalesce("s", F.lit(0.0))).alias("mean"),
            F.stddev_pop(F.coalesce("s", F.lit(0.0))).alias("std"),
            F.max(F.coalesce("hi", F.lit(0.0))).alias("max"),
            F.sum(F.coalesce("bad", zero)).alias("n_nan"),
            F.sum(F.coalesce("neg", zero)).alias("n_negative"),
            F.sum(F.coalesce("frac", zero)).alias("n_fractional"),
            F.count_if(F.coalesce("s", F.lit(0.0)) == 0).alias("n_zero"),
        )
    )


def check_counts(counts: DataFrame, obs: DataFrame, subject: str) -> DataFrame:
    """Errors for NaN, else for negative values; warnings for data that do not look
    like raw counts or rows that are empty."""
    s = count_statistics(counts, obs)
    cv = F.try_divide(F.col("std"), F.col("mean"))
    rules = [
        (F.col("n_nan") > 0, "count_nan", "error", F.col("n_nan"), F.lit("NaN values")),
        (
            (F.col("n_nan") == 0) & (F.col("n_negative") > 0),
            "count_negative",
            "error",
            F.col("n_negative"),
            F.lit("negative values"),
        ),
        ((F.col("mean") > 0) & (cv < MIN_ROW_CV), "row_sum_cv", "warn", F.lit(1), F.format_string("CV=%.4f", cv)),
        (F.col("max") < MIN_MAX_COUNT, "small_max", "warn", F.lit(1), F.format_string("max=%.3f", F.col("max"))),
        (
            F.col("n_fractional") > 0,
            "count_fractional",
            "warn",
            F.col("n_fractional"),
            F.lit("non-integer values"),
        ),
        (F.col("n_zero") > 0, "row_empty", "warn", F.col("n_zero"), F.lit("all-zero rows")),
    ]
    cases = [
        F.when(cond, F.struct(F.lit(c).alias("check"), F.lit(sev).alias("severity"), n.cast("bigint").alias("n"), d.cast("string").alias("detail")))
        for cond, c, sev, n, d in rules
    ]
    # One pass over the matrix for all rules.
    return (
        s.select(F.explode(F.array_compact(F.array(*cases))).alias("e"))
        .select(F.lit(subject).alias("subject"), "e.check", "e.severity", "e.n", "e.detail")
    )


def check_coordinates(obs: DataFrame, subject: str) -> DataFrame:
    """Missing coordinate columns or values."""
    if "px" not in obs.columns or "py" not in obs.columns:
        one = obs.agg(F.count(F.lit(1)).alias("n"))
        return _finding(one, F.lit(True), subject, "coordinates_missing", "error", F.col("n"), F.lit("no px, py"))
    s = obs.agg(F.count_if(F.col("px").isNull() | F.col("py").isNull()).alias("n"))
    return _finding(s, F.col("n") > 0, subject, "coordinates_missing", "error", F.col("n"), F.lit("NULL coordinate"))


def check_index_counts(index: DataFrame, name: str, subject: str, actual: dict[str, DataFrame]) -> DataFrame:
    """Index cells that state another count than the data hold.

    ``actual[column]`` is a one-row frame ``(n)``. Cells that are blank or no integer
    are ignored: index files are kept by hand.
    """
    row = index.where(F.col("Name") == name)
    parts = []
    for column, frame in actual.items():
        if column not in index.columns:
            continue
        n = frame.select("n").scalar()
        have = row.select(safe_int(f"`{column}`").alias("v"), n.alias("n"))
        parts.append(
            _finding(
                have,
                F.col("v").isNotNull() & (F.col("v") != F.col("n")),
                subject,
                f"index_{column}",
                "warn",
                F.col("n"),
                F.format_string(f"{column}=%d, actual=%d", F.col("v"), F.col("n")),
            )
        )
    return union_findings(parts) if parts else index.sparkSession.createDataFrame([], SCHEMA)


def index_count_mismatches(
    index: DataFrame, rows: DataFrame, name: str, column: str, key: str
) -> DataFrame:
    """``(name, stated, n)`` for every data set of an index whose stated count differs.

    ``rows(key, n)`` holds the actual counts of all data sets; one without rows has 0.
    """
    stated = index.select(F.col(name), safe_int(f"`{column}`").alias("stated"))
    actual = rows.select(F.col(key).alias(name), "n")
    return (
        stated.join(actual, name, "left")
        .select(name, "stated", F.coalesce("n", F.lit(0)).alias("n"))
        .where(F.col("stated").isNotNull() & (F.col("stated") != F.col("n")))
    )


def label_counts(obs: DataFrame) -> DataFrame:
    """``(key, n)``: distinct labels of every column of ``obs``."""
    n = [F.countDistinct(c).alias(c) for c in obs.columns]
    return obs.agg(*n).unpivot([], obs.columns, "key", "n")


def stated_keys(index: DataFrame, slots: int = 3) -> DataFrame:
    """``(Name, slot, key, stated)``: the label columns that index rows name, up to the
    first blank slot."""
    text = lambda c: F.trim(F.col(c).cast("string")) if c in index.columns else F.lit("")
    pairs = [F.struct(F.lit(i).alias("slot"), text(f"CellTypeKey{i}").alias("key"), text(f"NumberCellTypes{i}").alias("stated")) for i in range(slots)]
    rows = index.select("Name", F.inline(F.array(*pairs)))
    blank = F.min(F.when(F.coalesce("key", F.lit("")) == "", F.col("slot"))).over(W.partitionBy("Name"))
    return rows.withColumn("blank", blank).where(F.col("blank").isNull() | (F.col("slot") < F.col("blank"))).drop("blank")


def check_label_keys(obs: DataFrame, index: DataFrame, subject: str) -> DataFrame:
    """Label columns that the rows of ``index`` name: each must be a column of ``obs``, and
    a stated number of labels must be that of the column. Other text as number is ignored."""
    joined = stated_keys(index).join(label_counts(obs), "key", "left")
    stated = F.coalesce("stated", F.lit(""))
    number = safe_int("stated")
    one = F.lit(1).cast("bigint")

    def verdict(what: str, severity: str, n: Column, *words: Column) -> Column:
        return F.struct(F.lit(what).alias("what"), F.lit(severity).alias("severity"), n.alias("n"), F.concat_ws(" ", *words).alias("detail"))

    verdict_of = (
        F.when(F.col("n").isNull(), verdict("label_key_", "error", one, F.col("key"), F.lit("is no column")))
        .when(stated == "", verdict("label_count_", "warn", one, F.lit("no number stated for"), F.col("key")))
        .when(number != F.col("n"), verdict("label_count_", "warn", F.col("n"), F.col("key"), F.lit("has"), F.col("n"), F.lit("labels, stated"), stated))
    )
    found = joined.select("slot", verdict_of.alias("v")).where("v IS NOT NULL")
    return found.select(F.lit(subject).alias("subject"), F.concat("v.what", "slot").alias("check"), "v.severity", "v.n", "v.detail")


def check_pair(
    sc: DataFrame, st: DataFrame, st_obs: DataFrame, subject: str, stated_shared: str | None = None
) -> DataFrame:
    """Few shared features, a stated number that differs, and spots that are empty on
    the shared features."""
    shared = sc.select("feature").distinct().join(st.select("feature").distinct(), "feature", "left_semi")
    size = shared.agg(F.count(F.lit(1)).alias("n"))
    parts = [
        _finding(
            size,
            F.col("n") <= MIN_SHARED,
            subject,
            "few_shared",
            "warn",
            F.col("n"),
            F.format_string("only %d shared features", F.col("n")),
        )
    ]
    try:
        stated = int(stated_shared) if stated_shared is not None else None
    except ValueError:
        stated = None
    if stated is not None:
        parts.append(
            _finding(
                size,
                F.col("n") != stated,
                subject,
                "shared_mismatch",
                "warn",
                F.col("n"),
                F.format_string(f"stated {stated}, actual %d", F.col("n")),
            )
        )
    filled = st.where("x <> 0").join(shared, "feature", "left_semi").select("obs_id").distinct()
    empty = st_obs.join(filled, "obs_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    parts.append(
        _finding(
            empty.withColumn("shared", size.scalar()),
            (F.col("n") > 0) & (F.col("shared") > 0),
            subject,
            "spot_empty_shared",
            "warn",
            F.col("n"),
            F.lit("spots without shared counts"),
        )
    )
    return union_findings(parts)


def missing_in_index(names: DataFrame, index: DataFrame, side: str) -> DataFrame:
    """Names without a row in the index file."""
    absent = names.select("Name").distinct().join(index.select("Name"), "Name", "left_anti")
    return absent.select(
        F.concat(F.lit(f"{side}:"), F.col("Name")).alias("subject"),
        F.lit("index_row").alias("check"),
        F.lit("warn").alias("severity"),
        F.lit(1).cast("bigint").alias("n"),
        F.lit("no row in the index").alias("detail"),
    )


def status(findings: DataFrame, subjects: DataFrame) -> DataFrame:
    """``(subject, errors, warns, status)``: ERROR over WARN over OK."""
    per = findings.groupBy("subject").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warn").alias("warns"),
    )
    return (
        subjects.join(per, "subject", "left")
        .na.fill(0, ["errors", "warns"])
        .withColumn(
            "status",
            F.when(F.col("errors") > 0, "ERROR").when(F.col("warns") > 0, "WARN").otherwise("OK"),
        )
    )


def unique_ids(obs: DataFrame, key: str = "obs_id") -> DataFrame:
    """Appends ``-1``, ``-2``, ... to repeated ids; the first one keeps its name."""
    order = W.partitionBy(key).orderBy(F.monotonically_increasing_id())
    n = F.row_number().over(order) - 1
    return obs.withColumn("_n", n).withColumn(
        key, F.when(F.col("_n") == 0, F.col(key).cast("string")).otherwise(F.concat_ws("-", key, "_n"))
    ).drop("_n")
