"""Queries on K selection, validation and data preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from spotweave.functions.scalars import first_json_object, k_folder, nan_to_null, safe_int
from spotweave.operators import features, kselect, prep, validate
from spotweave.plans.base import TablePair, r6
from spotweave.plans.registry import query
from spotweave.plans.sql import define, r6 as s6, with_ctes
from spotweave.sources import readers, tables

# --- K table: per-brand aggregates stand in for the measured curves -------------------

_METRICS = {
    "cossim_hard_norm_spot": "avg(l_discount) * 9",
    "cossim_hard_norm_gene": "avg(l_tax) * 9",
    "cossim_hard_raw_spot": "avg(l_discount) * 10",
    "cossim_hard_raw_gene": "avg(l_tax) * 10",
    "cossim_hard_raw_spot_null": "avg(l_discount) * 5",
    "cossim_hard_raw_gene_null": "avg(l_tax) * 4",
    "nhood_mean_self_zscore": "avg(l_quantity) - 25.4",
    "local_purity_zscore": "stddev_pop(l_quantity) - 13.5",
    "modularity_shared": "avg(CAST(l_returnflag = 'R' AS DOUBLE))",
    "modularity_st_expression": "avg(CAST(l_linestatus = 'O' AS DOUBLE))",
    "mean_confidence": "max(l_discount) - avg(l_discount)",
}
define(
    "ktable",
    [],
    "SELECT CAST(dense_rank() OVER (ORDER BY p_brand) AS INTEGER) AS k, "
    + ", ".join(f"round(CAST({e} AS DOUBLE), 9) AS {n}" for n, e in _METRICS.items())
    + " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
)


def k_table(spark: SparkSession, sf: str) -> DataFrame:
    lines, parts = tables.table(spark, sf, "lineitem"), tables.table(spark, sf, "part")
    per = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(
        *[F.round(F.expr(f"CAST({e} AS DOUBLE)"), 9).alias(n) for n, e in _METRICS.items()]
    )
    # One row per brand is ranked; kept, since scales, scores and front all read it.
    return per.withColumn("k", F.dense_rank().over(W.orderBy("p_brand"))).drop("p_brand").persist()


def _hm(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL OR {a} < 0 OR {b} < 0 THEN NULL WHEN {a} + {b} > 0 THEN 2 * {a} * {b} / ({a} + {b}) ELSE 0 END"


define(
    "kscore",
    ["ktable"],
    f"""SELECT k, {_hm('cossim_hard_raw_spot', 'cossim_hard_raw_gene')} AS recon,
        {_hm('cossim_hard_raw_spot_null', 'cossim_hard_raw_gene_null')} AS recon_null,
        {_hm('nz', 'pz')} AS spatial, {_hm('modularity_st_expression', 'modularity_shared')} AS coherence
    FROM (SELECT *, CASE WHEN max(nhood_mean_self_zscore) OVER () > 0 THEN nhood_mean_self_zscore / max(nhood_mean_self_zscore) OVER () END AS nz,
            CASE WHEN max(local_purity_zscore) OVER () > 0 THEN local_purity_zscore / max(local_purity_zscore) OVER () END AS pz
          FROM ktable)""",
)
define(
    "koverall",
    ["kscore"],
    """SELECT *, CASE WHEN recon > 0 AND spatial > 0 AND coherence > 0
        THEN 3 / (1 / recon + 1 / spatial + 1 / coherence) END AS overall FROM kscore""",
)
define(
    "kfront",
    ["koverall"],
    """SELECT a.*, NOT EXISTS (SELECT 1 FROM koverall b WHERE
            COALESCE(b.recon, -1e300) >= COALESCE(a.recon, -1e300) AND COALESCE(b.spatial, -1e300) >= COALESCE(a.spatial, -1e300)
        AND COALESCE(b.coherence, -1e300) >= COALESCE(a.coherence, -1e300)
        AND (COALESCE(b.recon, -1e300) > COALESCE(a.recon, -1e300) OR COALESCE(b.spatial, -1e300) > COALESCE(a.spatial, -1e300)
          OR COALESCE(b.coherence, -1e300) > COALESCE(a.coherence, -1e300))) AS pareto FROM koverall a""",
)


def _n6(name: str) -> Column:
    return r6(nan_to_null(name)).alias(name)


@query(
    "kscore_table",
    with_ctes(
        f"SELECT k, {s6('recon')} AS recon, {s6('recon_null')} AS recon_null, {s6('spatial')} AS spatial, {s6('coherence')} AS coherence FROM kscore",
        "kscore",
    ),
)
def kscore_table(spark: SparkSession, sf: str) -> DataFrame:
    s = kselect.score_table(k_table(spark, sf))
    return s.select("k", *[_n6(c) for c in ("recon", "recon_null", "spatial", "coherence")])


@query(
    "scale_factors",
    with_ctes(
        f"""SELECT 'spatial' AS key, 'nhood_mean_self_zscore' AS curve, {s6('1 / max(nhood_mean_self_zscore)')} AS factor FROM ktable
        UNION ALL SELECT 'spatial', 'local_purity_zscore', {s6('1 / max(local_purity_zscore)')} FROM ktable
        UNION ALL SELECT unnest(['recon', 'recon', 'coherence', 'coherence']),
            unnest(['cossim_hard_raw_spot', 'cossim_hard_raw_gene', 'modularity_st_expression', 'modularity_shared']), 1.0""",
        "ktable",
    ),
)
def scale_factors(spark: SparkSession, sf: str) -> DataFrame:
    return kselect.scale_factors(k_table(spark, sf)).select("key", "curve", r6("factor").alias("factor"))


@query("overall_score", with_ctes(f"SELECT k, {s6('overall')} AS overall FROM koverall", "koverall"))
def overall_score(spark: SparkSession, sf: str) -> DataFrame:
    return kselect.score_metrics(k_table(spark, sf)).select("k", _n6("overall"))


@query("pareto_front", with_ctes("SELECT k, pareto FROM kfront", "kfront"))
def pareto_front(spark: SparkSession, sf: str) -> DataFrame:
    return kselect.score_metrics(k_table(spark, sf)).select("k", "pareto")


@query(
    "best_k",
    with_ctes(
        "\nUNION ALL ".join(
            f"SELECT '{n}' AS name, (SELECT k FROM koverall WHERE {n} IS NOT NULL ORDER BY {n} DESC, k LIMIT 1) AS k, "
            f"(SELECT {s6(f'max({n})')} FROM koverall) AS score"
            for n in ("overall", "recon", "spatial", "coherence")
        ),
        "koverall",
    ),
)
def best_k(spark: SparkSession, sf: str) -> DataFrame:
    best = kselect.best_ks(kselect.score_metrics(k_table(spark, sf)))
    return best.select("name", "k", _n6("score"))


@query("k_selection")
def k_selection(spark: SparkSession, sf: str) -> DataFrame:
    return kselect.selection(kselect.score_metrics(k_table(spark, sf)))


@query(
    "k_metric_collection",
    with_ctes(
        "SELECT k, " + ", ".join(s6(c) + f" AS {c}" if not c.startswith("cossim_hard_norm") else f"CAST(NULL AS DOUBLE) AS {c}" for c in kselect.METRIC_COLUMNS) + " FROM ktable",
        "ktable",
    ),
)
def k_metric_collection(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics from two sources brought together; a metric nobody measured is missing."""
    t = k_table(spark, sf)
    have = [c for c in kselect.METRIC_COLUMNS if not c.startswith("cossim_hard_norm")]
    out = kselect.collect_metrics(t.select("k"), [t.select("k", *have[:4]), t.select("k", *have[4:])])
    return out.select("k", *[_n6(c) for c in kselect.METRIC_COLUMNS])


@query(
    "k_table_backfill",
    with_ctes(
        f"SELECT k, {s6('cossim_hard_raw_spot')} AS cossim_hard_raw_spot, {s6('modularity_st_expression')} AS modularity_st_expression FROM ktable",
        "ktable",
    ),
)
def k_table_backfill(spark: SparkSession, sf: str) -> DataFrame:
    t = k_table(spark, sf)
    old, lookup = t.select("k", "cossim_hard_raw_spot"), t.select("k", "modularity_st_expression")
    out = kselect.fill_missing(old, lookup, ["modularity_st_expression"])
    return out.select("k", _n6("cossim_hard_raw_spot"), _n6("modularity_st_expression"))


# --- validation -----------------------------------------------------------------------


@query(
    "validate_counts",
    with_ctes(
        """SELECT * FROM (
            SELECT 'sc' AS subject, 'small_max' AS check, 'warn' AS severity, CAST(1 AS BIGINT) AS n FROM sc HAVING max(x) < 20
            UNION ALL SELECT 'sc', 'row_empty', 'warn', count(*) FROM sc_obs WHERE obs_id NOT IN (SELECT obs_id FROM sc WHERE x <> 0) HAVING count(*) > 0
            UNION ALL SELECT 'sc', 'count_negative', 'error', count(*) FROM sc WHERE x < 0 HAVING count(*) > 0
            UNION ALL SELECT 'sc', 'count_fractional', 'warn', count(*) FROM sc WHERE abs(x - round(x)) > 1e-4 HAVING count(*) > 0
            UNION ALL SELECT 'st', 'row_empty', 'warn', count(*) FROM st_obs WHERE obs_id NOT IN (SELECT obs_id FROM st WHERE x <> 0) HAVING count(*) > 0
            UNION ALL SELECT 'lx', 'small_max', 'warn', 1 FROM sts HAVING max(lx) < 20
            UNION ALL SELECT 'lx', 'count_fractional', 'warn', count(*) FROM sts WHERE abs(lx - round(lx)) > 1e-4 HAVING count(*) > 0
            UNION ALL SELECT 'lx', 'row_sum_cv', 'warn', 1 FROM (SELECT SUM(lx) AS s FROM sts GROUP BY obs_id) HAVING stddev_pop(s) / avg(s) < 0.01
        )""",
        "sc",
        "sc_obs",
        "st",
        "st_obs",
        "sts",
    ),
)
def validate_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = TablePair(spark, sf)
    logged = p.st_shared.select("obs_id", "feature", F.col("lx").alias("x"))
    parts = [
        validate.check_counts(p.sc, p.sc_obs, "sc"),
        validate.check_counts(p.st, p.st_obs, "st"),
        validate.check_counts(logged, p.st_obs, "lx"),
    ]
    return validate.union_findings(parts).select("subject", "check", "severity", "n")


@query(
    "count_statistics",
    with_ctes(
        f"""SELECT count(*) AS n_obs, {s6('avg(s)')} AS mean, {s6('stddev_pop(s)')} AS std, {s6('max(hi)')} AS max,
            count(*) FILTER (WHERE s = 0) AS n_zero
        FROM (SELECT o.obs_id, COALESCE(SUM(x), 0) AS s, COALESCE(max(x), 0) AS hi FROM sc_obs o LEFT JOIN sc USING (obs_id) GROUP BY o.obs_id)""",
        "sc",
        "sc_obs",
    ),
)
def count_statistics(spark: SparkSession, sf: str) -> DataFrame:
    p = TablePair(spark, sf)
    s = validate.count_statistics(p.sc, p.sc_obs)
    return s.select("n_obs", *[r6(c).alias(c) for c in ("mean", "std", "max")], "n_zero")


@query(
    "validate_features",
    """SELECT 'part' AS subject, 'feature_case' AS check, 'error' AS severity, count(*) AS n FROM part WHERE p_name <> upper(p_name) HAVING count(*) > 0
    UNION ALL SELECT 'part', 'feature_duplicate', 'error', count(*) FROM (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1) HAVING count(*) > 0""",
)
def validate_features(spark: SparkSession, sf: str) -> DataFrame:
    var = tables.table(spark, sf, "part").select(F.col("p_name").alias("feature"))
    return validate.check_features(var, "part").select("subject", "check", "severity", "n")


@query(
    "validate_pair",
    with_ctes(
        """SELECT 'pair' AS subject, 'few_shared' AS check, 'warn' AS severity, count(*) AS n FROM shared HAVING count(*) <= 10
        UNION ALL SELECT 'pair', 'shared_mismatch', 'warn', count(*) FROM shared HAVING count(*) <> 7
        UNION ALL SELECT 'pair', 'spot_empty_shared', 'warn', count(*) FROM st_obs WHERE obs_id NOT IN (SELECT obs_id FROM sts WHERE x <> 0) HAVING count(*) > 0""",
        "shared",
        "sts",
        "st_obs",
    ),
)
def validate_pair(spark: SparkSession, sf: str) -> DataFrame:
    p = TablePair(spark, sf)
    return validate.check_pair(p.sc, p.st, p.st_obs, "pair", "7").select("subject", "check", "severity", "n")


@query(
    "validate_coordinates",
    "SELECT 'st' AS subject, 'coordinates_missing' AS check, 'error' AS severity, count(*) AS n FROM supplier WHERE s_acctbal IS NULL OR s_nationkey IS NULL HAVING count(*) > 0",
)
def validate_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    out = validate.check_coordinates(tables.supplier_rows(spark, sf), "st")
    return out.select("subject", "check", "severity", "n")


@query(
    "validate_labels",
    """SELECT 'sc' AS subject, 'label_count_0' AS check, 'warn' AS severity, count(DISTINCT n_name) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey HAVING count(DISTINCT n_name) <> 3
    UNION ALL SELECT 'sc', 'label_count_1', 'warn', 1
    UNION ALL SELECT 'sc', 'label_key_2', 'error', 1""",
)
def validate_labels(spark: SparkSession, sf: str) -> DataFrame:
    # One index row, posed on the first nation: a wrong number, no number, no such column.
    names = {"CellTypeKey0": "label", "NumberCellTypes0": "3", "CellTypeKey1": "segment", "CellTypeKey2": "absent"}
    nation = tables.table(spark, sf, "nation").where("n_nationkey = 0")
    index = nation.select(F.col("n_name").alias("Name"), *(F.lit(v).alias(k) for k, v in names.items()))
    out = validate.check_label_keys(tables.customer_rows(spark, sf), index, "sc")
    return out.select("subject", "check", "severity", "n")


def _nation_index(spark: SparkSession, sf: str) -> DataFrame:
    """An index table per nation whose counts are the region key: text, often wrong."""
    nation = tables.table(spark, sf, "nation")
    return nation.select(
        F.col("n_name").alias("Name"),
        F.when(F.col("n_regionkey") == 0, F.lit("n/a")).otherwise(F.col("n_regionkey").cast("string")).alias("CellCount"),
    )


@query(
    "index_crosscheck",
    """SELECT n_name AS subject, n AS actual, n_regionkey AS stated FROM (
        SELECT n_name, n_regionkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_regionkey)
    WHERE n_regionkey <> 0 AND n <> n_regionkey""",
)
def index_crosscheck(spark: SparkSession, sf: str) -> DataFrame:
    """Stated against actual counts of all data sets; blank or textual cells are skipped."""
    rows = tables.customer_rows(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    index = _nation_index(spark, sf)
    out = validate.index_count_mismatches(index, rows, "Name", "CellCount", "label")
    return out.select(F.col("Name").alias("subject"), F.col("n").alias("actual"), F.col("stated").cast("int").alias("stated"))


@query(
    "index_missing",
    "SELECT 'sc:' || s_name AS subject, 'index_row' AS check, 'warn' AS severity FROM supplier WHERE s_name NOT IN (SELECT n_name FROM nation)",
)
def index_missing(spark: SparkSession, sf: str) -> DataFrame:
    names = tables.table(spark, sf, "supplier").select(F.col("s_name").alias("Name"))
    return validate.missing_in_index(names, _nation_index(spark, sf), "sc").select("subject", "check", "severity")


@query(
    "validation_status",
    """SELECT p_name AS subject, CAST(SUM(CASE WHEN p_retailprice > 950 THEN 1 ELSE 0 END) AS BIGINT) AS errors,
        CAST(SUM(CASE WHEN p_retailprice <= 950 AND p_size < 25 THEN 1 ELSE 0 END) AS BIGINT) AS warns,
        CASE WHEN SUM(CASE WHEN p_retailprice > 950 THEN 1 ELSE 0 END) > 0 THEN 'ERROR'
             WHEN SUM(CASE WHEN p_retailprice <= 950 AND p_size < 25 THEN 1 ELSE 0 END) > 0 THEN 'WARN' ELSE 'OK' END AS status
    FROM part GROUP BY p_name""",
)
def validation_status(spark: SparkSession, sf: str) -> DataFrame:
    part = tables.table(spark, sf, "part")
    found = part.select(
        F.col("p_name").alias("subject"),
        F.when(F.col("p_retailprice") > 950, "error").when(F.col("p_size") < 25, "warn").alias("severity"),
    ).where("severity IS NOT NULL")
    return validate.status(found, part.select(F.col("p_name").alias("subject")).distinct())


# --- preparation ----------------------------------------------------------------------


@query(
    "feature_collapse",
    """SELECT l_suppkey AS obs_id, upper(f) AS feature, SUM(l_quantity) AS x FROM (
        SELECT l_suppkey, l_quantity, CASE WHEN p_size % 2 = 0 THEN p_type ELSE lower(p_type) END AS f
        FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2""",
)
def feature_collapse(spark: SparkSession, sf: str) -> DataFrame:
    lines, parts = tables.table(spark, sf, "lineitem"), tables.table(spark, sf, "part")
    mixed = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.lower("p_type"))
    counts = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_suppkey").alias("obs_id"), mixed.alias("feature"))
        .agg(F.sum("l_quantity").alias("x"))
    )
    return features.collapse_features(counts)


@query(
    "drop_bad_labels",
    "SELECT n_regionkey AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name NOT IN ('NATION_3', 'NATION_7') GROUP BY n_regionkey",
)
def drop_bad_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "customer").join(
        tables.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    good = prep.drop_bad_labels(rows, "n_name", [*prep.BAD_LABELS, "NATION_3", "NATION_7"])
    return good.groupBy(F.col("n_regionkey").alias("region")).agg(F.count(F.lit(1)).alias("n"))


@query("keep_region", "SELECT s_suppkey AS obs_id FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
def keep_region(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = (tables.table(spark, sf, t) for t in ("supplier", "nation", "region"))
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return prep.keep_region(rows, "r_name", "EUROPE").select(F.col("s_suppkey").alias("obs_id"))


@query(
    "rows_with_counts",
    with_ctes("SELECT obs_id FROM sc_obs WHERE obs_id IN (SELECT obs_id FROM sc WHERE x <> 0 AND feature IN (SELECT feature FROM shared))", "sc_obs", "sc", "shared"),
)
def rows_with_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = TablePair(spark, sf)
    return prep.rows_with_counts(p.sc_obs, p.sc, p.shared).select("obs_id")


@query(
    "drop_singletons",
    "SELECT s_suppkey AS obs_id, s_nationkey AS g FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY s_nationkey HAVING count(*) > 1)",
)
def drop_singletons(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("obs_id"), F.col("s_nationkey").alias("g"))
    return prep.drop_singleton_groups(rows, "g").select("obs_id", "g")


_BOXES = [(0.0, 0.0, 12.0, 4000.0), (8.0, 3000.0, 20.0, 9000.0)]
_BOX_SQL = "CASE WHEN px BETWEEN 0 AND 12 AND py BETWEEN 0 AND 4000 THEN 0 WHEN px BETWEEN 8 AND 20 AND py BETWEEN 3000 AND 9000 THEN 1 ELSE -1 END"


@query("box_assign", with_ctes(f"SELECT obs_id, {_BOX_SQL} AS box FROM st_obs", "st_obs"))
def box_assign(spark: SparkSession, sf: str) -> DataFrame:
    return prep.assign_boxes(tables.supplier_rows(spark, sf), _BOXES).select("obs_id", "box")


@query(
    "box_assign_table",
    with_ctes(
        """SELECT s.obs_id, COALESCE(min(b.box), -1) AS box FROM st_obs s LEFT JOIN (
            SELECT CAST(r_regionkey AS INTEGER) AS box, r_regionkey * 4.0 AS x0, r_regionkey * 4.0 + 6 AS x1, r_regionkey * 1000.0 AS y0, r_regionkey * 1000.0 + 5000 AS y1 FROM region) b
            ON px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 GROUP BY s.obs_id""",
        "st_obs",
    ),
)
def box_assign_table(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("r_regionkey")
    boxes = tables.table(spark, sf, "region").select(
        r.cast("int").alias("box"), (r * 4.0).alias("x0"), (r * 4.0 + 6).alias("x1"), (r * 1000.0).alias("y0"), (r * 1000.0 + 5000).alias("y1")
    )
    return prep.assign_boxes_table(tables.supplier_rows(spark, sf), boxes).select("obs_id", "box")


_BIN = "least(CAST(floor(({v} - min({v}) OVER ()) / nullif(max({v}) OVER () - min({v}) OVER (), 0) * 4) AS INTEGER), 3)"


@query(
    "grid_split",
    with_ctes(
        f"""SELECT obs_id, r AS row, c AS col, 'patch_' || r || '_' || c AS patch FROM (
            SELECT obs_id, {_BIN.format(v='px')} AS r, {_BIN.format(v='py')} AS c FROM st_obs)""",
        "st_obs",
    ),
)
def grid_split(spark: SparkSession, sf: str) -> DataFrame:
    return prep.grid_patches(tables.supplier_rows(spark, sf), 4).select("obs_id", "row", "col", "patch")


@query(
    "grid_summary",
    with_ctes(
        f"""SELECT 'patch_' || d.r || '_' || d.c AS patch, count(g.obs_id) AS spots FROM
            (SELECT a.r, b.c FROM (SELECT unnest(range(0, 4)) AS r) a, (SELECT unnest(range(0, 4)) AS c) b) d
        LEFT JOIN (SELECT obs_id, {_BIN.format(v='px')} AS r, {_BIN.format(v='py')} AS c FROM st_obs) g ON g.r = d.r AND g.c = d.c
        GROUP BY d.r, d.c""",
        "st_obs",
    ),
)
def grid_summary(spark: SparkSession, sf: str) -> DataFrame:
    return prep.patch_summary(prep.grid_patches(tables.supplier_rows(spark, sf), 4), 4)


@query(
    "grid_offset",
    f"""SELECT s_suppkey AS obs_id, {s6('px - lx + (t % nc) * w * 1.1')} AS gx, {s6('py - ly + (t // nc) * h * 1.1')} AS gy FROM (
        SELECT s_suppkey, s_suppkey * 1.0 AS px, s_acctbal AS py, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS lx,
            min(s_acctbal) OVER (PARTITION BY s_nationkey) AS ly, dense_rank() OVER (ORDER BY s_nationkey) - 1 AS t,
            CAST(ceil(sqrt((SELECT count(DISTINCT s_nationkey) FROM supplier))) AS INTEGER) AS nc,
            max(s_suppkey) OVER () - min(s_suppkey) OVER () AS w, max(s_acctbal) OVER () - min(s_acctbal) OVER () AS h FROM supplier)""",
)
def grid_offset(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("obs_id"), "s_nationkey", F.col("s_suppkey").cast("double").alias("px"), F.col("s_acctbal").alias("py")
    )
    return prep.grid_offset(rows, "s_nationkey").select("obs_id", r6("gx").alias("gx"), r6("gy").alias("gy"))


_NAME_SQL = "CASE WHEN s_suppkey % 4 = 0 THEN s_name WHEN s_suppkey % 4 = 1 THEN s_nationkey || '_t' || s_suppkey WHEN s_suppkey % 4 = 2 THEN s_nationkey || '_' || (s_suppkey % 10) || '_t' || s_suppkey ELSE s_nationkey || '_' || (s_suppkey % 10) || '_' || (s_suppkey % 3) || '_t' || s_suppkey END"
_KEY_SQL = """CASE WHEN regexp_matches(Name, '^[0-9]+_') THEN CAST(regexp_extract(Name, '^([0-9]+)_', 1) AS INTEGER) ELSE 999 END AS k1,
    CASE WHEN NOT regexp_matches(Name, '^[0-9]+_') THEN 999 WHEN regexp_matches(Name, '^[0-9]+_[0-9]+_') THEN CAST(regexp_extract(Name, '^[0-9]+_([0-9]+)_', 1) AS INTEGER) ELSE 0 END AS k2,
    CASE WHEN NOT regexp_matches(Name, '^[0-9]+_') THEN 999 WHEN regexp_matches(Name, '^[0-9]+_[0-9]+_[0-9]+_') THEN CAST(regexp_extract(Name, '^[0-9]+_[0-9]+_([0-9]+)_', 1) AS INTEGER) ELSE 0 END AS k3"""


def _names(spark: SparkSession, sf: str) -> DataFrame:
    """Data-set names of every form the natural sort knows, from the suppliers."""
    s = tables.table(spark, sf, "supplier")
    key, nat = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    last = F.concat(F.lit("t"), key.cast("string"))
    two, three = F.pmod(key, F.lit(10)).cast("string"), F.pmod(key, F.lit(3)).cast("string")
    form = F.pmod(key, F.lit(4))
    return s.select(
        F.when(form == 0, F.col("s_name"))
        .when(form == 1, F.concat_ws("_", nat, last))
        .when(form == 2, F.concat_ws("_", nat, two, last))
        .otherwise(F.concat_ws("_", nat, two, three, last))
        .alias("Name")
    )


@query("natural_sort_keys", f"SELECT Name, {_KEY_SQL} FROM (SELECT {_NAME_SQL} AS Name FROM supplier)")
def natural_sort_keys(spark: SparkSession, sf: str) -> DataFrame:
    return prep.sort_names(_names(spark, sf))


@query(
    "renumber_ids",
    f"SELECT Name, row_number() OVER (ORDER BY k1, k2, k3, Name) - 1 AS new_id FROM (SELECT Name, {_KEY_SQL} FROM (SELECT {_NAME_SQL} AS Name FROM supplier))",
)
def renumber_ids(spark: SparkSession, sf: str) -> DataFrame:
    return prep.renumber(_names(spark, sf)).select("Name", "new_id")


@query(
    "append_dedup",
    """SELECT o_custkey AS key, CAST('orders' AS VARCHAR) AS src FROM (SELECT DISTINCT o_custkey FROM orders)
    UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
)
def append_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Customers appended to the keys of the orders: those without an order are new."""
    have = tables.table(spark, sf, "orders").select(F.col("o_custkey").alias("key")).distinct()
    more = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    return prep.append_rows(
        have.withColumn("src", F.lit("orders")), more.withColumn("src", F.lit("customer")).withColumn("extra", F.lit(1)), "key"
    )


@query("next_id", "SELECT max(try_cast(replace(s_name, 'Supplier#', '') AS BIGINT)) + 1 AS next_id FROM supplier")
def next_id(spark: SparkSession, sf: str) -> DataFrame:
    names = tables.table(spark, sf, "supplier").select(F.regexp_replace("s_name", "Supplier#", "").alias("PairID"))
    return prep.next_id(names)


@query(
    "unpivot_wide",
    "SELECT user_id AS obs_id, event_type AS feature, CAST(count(*) AS DOUBLE) AS x FROM events GROUP BY user_id, event_type",
)
def unpivot_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Users x event types as a wide table, back to long counts."""
    wide = tables.event_counts(spark, sf).groupBy("obs_id").pivot("feature").agg(F.first("x")).na.fill(0.0)
    return readers.unpivot_wide(wide, "obs_id", "obs_id", "feature")


@query(
    "aligned_sum",
    """SELECT obs_id, feature, SUM(x) AS x FROM (
        SELECT user_id AS obs_id, event_type AS feature, CAST(count(*) AS DOUBLE) AS x FROM events GROUP BY 1, 2
        UNION ALL SELECT CAST(day(ts) AS BIGINT), event_type, CAST(count(*) AS DOUBLE) FROM events GROUP BY 1, 2) GROUP BY 1, 2""",
)
def aligned_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Events per user and events per day of the month, added where the row numbers meet."""
    daily = (
        tables.table(spark, sf, "events")
        .groupBy(F.dayofmonth("ts").cast("bigint").alias("obs_id"), F.col("event_type").alias("feature"))
        .agg(F.count(F.lit(1)).cast("double").alias("x"))
    )
    return features.sum_aligned([tables.event_counts(spark, sf), daily])


@query(
    "key_translation",
    "SELECT o_custkey AS obs_id, COALESCE(n_name, CAST(c_nationkey AS VARCHAR)) AS feature, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
)
def key_translation(spark: SparkSession, sf: str) -> DataFrame:
    """Nation keys of the orders translated by the best matching nation column."""
    rows = tables.table(spark, sf, "orders").join(
        tables.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    keys = rows.select(F.col("o_custkey").alias("obs_id"), F.col("c_nationkey").cast("string").alias("feature"))
    lookup = tables.table(spark, sf, "nation")
    column, _ = features.best_key_column(keys.select(F.col("feature").alias("key")), lookup)
    named = features.translate_keys(keys, lookup, column, "n_name")
    return named.groupBy("obs_id", "feature").agg(F.count(F.lit(1)).alias("n"))


@query(
    "attach_labels",
    "SELECT c_custkey AS obs_id, s_name FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey",
)
def attach_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier names attached to the customers of the same number; most have none."""
    names = tables.table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return prep.attach_labels(tables.customer_rows(spark, sf), names, "s_suppkey", "s_name").select("obs_id", "s_name")


@query(
    "annotated_rows",
    """SELECT 'kept' AS what, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT 'missing', count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""",
)
def annotated_rows(spark: SparkSession, sf: str) -> DataFrame:
    kept, missing = prep.annotated_rows(tables.customer_rows(spark, sf), tables.table(spark, sf, "orders"), "o_custkey")
    return kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("what"), "n").unionByName(
        missing.select(F.lit("missing").alias("what"), F.col("missing").alias("n"))
    )


@query(
    "safe_scalars",
    """SELECT event_id, try_cast(trim(json_extract_string(props, '$.k')) AS BIGINT) AS v, printf('k_%03d', event_id % 1500) AS folder,
        regexp_extract('noise ' || props || ' tail', '\\{[^{}]*\\}', 0) AS doc FROM events""",
)
def safe_scalars(spark: SparkSession, sf: str) -> DataFrame:
    events = tables.table(spark, sf, "events")
    noisy = events.select(
        "event_id",
        F.get_json_object("props", "$.k").alias("raw"),
        F.concat(F.lit("noise "), F.col("props"), F.lit(" tail")).alias("text"),
    )
    return noisy.select(
        "event_id",
        safe_int("raw").alias("v"),
        k_folder(F.col("event_id") % 1500).alias("folder"),
        first_json_object("text").alias("doc"),
    )


_UNIFORM = "(('0x' || substr(md5('42:' || o.obs_id || ':' || f.feature), {at}, 13))::BIGINT + 1) / 4503599627370497.0"


@query(
    "noise_statistics",
    with_ctes(
        f"""SELECT feature, count(*) AS n, {s6('avg(x)')} AS mean, {s6('min(x)')} AS low FROM (
            SELECT f.feature, greatest(0, COALESCE(x, 0) + 0.5 * (SELECT stddev_pop(COALESCE(x, 0)) FROM st_obs CROSS JOIN shared
                    LEFT JOIN sts USING (obs_id, feature))
                * sqrt(-2 * ln({_UNIFORM.format(at=1)})) * cos(2 * pi() * {_UNIFORM.format(at=14)})) AS x
            FROM st_obs o CROSS JOIN shared f LEFT JOIN sts t ON t.obs_id = o.obs_id AND t.feature = f.feature
        ) GROUP BY feature""",
        "st_obs",
        "sts",
    ),
)
def noise_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier counts with Gaussian noise: rows, mean and smallest value per feature."""
    p = TablePair(spark, sf)
    noisy = prep.gaussian_noise(p.st_shared, p.st_obs, p.shared, 0.5)
    return noisy.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x")).alias("mean"), r6(F.min("x")).alias("low"))


@query(
    "random_subset",
    with_ctes(
        "SELECT obs_id FROM sc_obs WHERE obs_id IN (SELECT obs_id FROM sc WHERE x <> 0) ORDER BY md5('42:' || obs_id), obs_id LIMIT 15",
        "sc_obs",
        "sc",
    ),
)
def random_subset(spark: SparkSession, sf: str) -> DataFrame:
    """A seeded sample of customers that have counts; the limit is the operator."""
    p = TablePair(spark, sf)
    return prep.random_subset(prep.rows_with_counts(p.sc_obs, p.sc), 15, seed=42).select("obs_id")


_SMALL = """SELECT '{side}' AS side, obs_id, feature, x FROM {table}
    WHERE obs_id IN (SELECT obs_id FROM {table}_obs WHERE obs_id IN (SELECT obs_id FROM {table} WHERE x <> 0 AND feature IN ({used}))
        ORDER BY md5('7:' || obs_id), obs_id LIMIT {rows})
    AND feature IN (SELECT feature FROM (SELECT feature FROM shared ORDER BY feature LIMIT {n})
        UNION ALL SELECT feature FROM (SELECT DISTINCT feature FROM {table} WHERE feature NOT IN (SELECT feature FROM shared) ORDER BY feature LIMIT 2))"""


@query(
    "small_pair",
    with_ctes(
        _SMALL.format(side="sc", table="sc", used="SELECT feature FROM shared ORDER BY feature LIMIT 3", rows=40, n=3)
        + " UNION ALL "
        + _SMALL.format(side="st", table="st", used="SELECT feature FROM shared", rows=12, n=3),
        "sc_obs",
        "st_obs",
        "shared",
    ),
)
def small_pair(spark: SparkSession, sf: str) -> DataFrame:
    """A smaller pair of matrices: 40 customers, 12 suppliers, 3 shared features and 2 own ones a side."""
    p = TablePair(spark, sf)
    a, b = prep.small_pair(p.sc, p.st, p.sc_obs, p.st_obs, 40, 5, 12, 5, 3, seed=7)
    columns = ("obs_id", "feature", "x")
    return a.select(F.lit("sc").alias("side"), *columns).unionByName(b.select(F.lit("st").alias("side"), *columns))


@query(
    "register_patches",
    with_ctes(
        f"""SELECT s_nationkey || '_' || i || '_t' AS Name, CAST(spots AS VARCHAR) AS SpotCount FROM (
            SELECT 7 AS s_nationkey, row_number() OVER (ORDER BY r, c) AS i, spots FROM (
                SELECT r, c, count(*) AS spots FROM (SELECT {_BIN.format(v='px')} AS r, {_BIN.format(v='py')} AS c FROM st_obs) GROUP BY r, c))
        UNION ALL SELECT n_name, CAST(n_regionkey AS VARCHAR) FROM nation""",
        "st_obs",
    ),
)
def register_patches(spark: SparkSession, sf: str) -> DataFrame:
    """A spatial set `7_t` replaced in the index by its patches."""
    summary = prep.patch_summary(prep.grid_patches(tables.supplier_rows(spark, sf), 4), 4)
    nation = tables.table(spark, sf, "nation")
    others = nation.select(F.col("n_name").alias("Name"), F.col("n_regionkey").cast("string").alias("SpotCount"))
    base = nation.agg(F.lit("7_t").alias("Name"), F.count(F.lit(1)).cast("string").alias("SpotCount"))
    pairs = nation.select(F.col("n_nationkey").alias("PairID"), F.col("n_name").alias("scName"), F.lit("7_t").alias("stName"))
    index, _ = prep.register_patches(others.unionByName(base), pairs, summary, "7_t")
    return index.select("Name", "SpotCount")
