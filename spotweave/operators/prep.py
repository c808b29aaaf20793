"""Data preparation: filters, splits, subsets, noise, index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spotweave.functions.indexing import exact_median, ordered_index
from spotweave.functions.scalars import equal_width_bin, natural_key
from spotweave.operators.knn import knn_join

# Labels that mean "no usable label".
BAD_LABELS = ["nan", "NA", "", "none", "low quality", "Low Quality"]
TILE_GAP = 1.1


def drop_bad_labels(obs: DataFrame, label: str, bad: list[str] = BAD_LABELS) -> DataFrame:
    return obs.where(~F.coalesce(F.col(label).cast("string"), F.lit("nan")).isin(bad))


def keep_region(obs: DataFrame, column: str, value: str) -> DataFrame:
    return obs.where(F.col(column) == value)


def rows_with_counts(obs: DataFrame, counts: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Rows with a non-zero value in the given features (in any feature by default)."""
    used = counts.where("x <> 0")
    if features is not None:
        used = used.join(features, "feature", "left_semi")
    return obs.join(used.select("obs_id").distinct(), "obs_id", "left_semi")


def drop_singleton_groups(obs: DataFrame, label: str) -> DataFrame:
    """Rows of groups with at least two members."""
    lone = obs.groupBy(label).count().where("count = 1").select(label)
    return obs.join(lone, label, "left_anti")


def assign_boxes(spots: DataFrame, boxes: list[tuple[float, float, float, float]]) -> DataFrame:
    """Adds ``box``: the first box (x0, y0, x1, y1; edges included) holding the spot, or -1."""
    hit: Column = F.lit(-1)
    for i in range(len(boxes) - 1, -1, -1):
        x0, y0, x1, y1 = boxes[i]
        hit = F.when(F.col("px").between(x0, x1) & F.col("py").between(y0, y1), F.lit(i)).otherwise(hit)
    return spots.withColumn("box", hit.cast("int"))


def assign_boxes_table(spots: DataFrame, boxes: DataFrame) -> DataFrame:
    """As ``assign_boxes`` for boxes in a table ``(box, x0, y0, x1, y1)`` of any size; the lowest number
    wins. Spots have distinct ids; a box with a NULL, infinite or reversed edge holds none.

    A box lies in at most four tiles of the grid whose tiles are as wide as its longer side, rounded up
    to a power of two. Spots meet boxes on the tile, once per width in use.
    """
    edges = [F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]
    x0, y0, x1, y1 = edges
    finite = F.lit(True)
    for e in edges:
        finite = finite & e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(1e300))
    side = F.greatest(x1 - x0, y1 - y0, F.lit(2.0**-30))
    sized = boxes.where(finite & (x0 <= x1) & (y0 <= y1)).withColumn("_t", F.pow(F.lit(2.0), F.ceil(F.log2(side)).cast("double")))
    tile = lambda v: F.floor(v / F.col("_t")).cast("bigint")
    tiles = sized.withColumn("_x", F.explode(F.sequence(tile(x0), tile(x1)))).withColumn("_y", F.explode(F.sequence(tile(y0), tile(y1))))
    widths = [r["_t"] for r in sized.select("_t").distinct().collect()]  # one per power of two
    if not widths:
        return spots.withColumn("box", F.lit(-1))
    near = spots.select("obs_id", "px", "py", F.explode(F.array(*(F.lit(w) for w in widths))).alias("_t"))
    near = near.withColumn("_x", tile(F.col("px"))).withColumn("_y", tile(F.col("py")))
    hits = near.join(tiles, ["_t", "_x", "_y"]).where(F.col("px").between(x0, x1) & F.col("py").between(y0, y1))
    lowest = hits.groupBy("obs_id").agg(F.min("box").cast("int").alias("box"))
    return spots.join(lowest, "obs_id", "left").withColumn("box", F.coalesce("box", F.lit(-1)))


def fill_from_nearest(assigned: DataFrame) -> DataFrame:
    """Gives spots outside every box the box of the nearest covered spot."""
    vec = F.array(F.col("px").cast("double"), F.col("py").cast("double")).alias("vec")
    free = assigned.where("box = -1")
    covered = assigned.where("box <> -1")
    near = knn_join(free.select("obs_id", vec), covered.select("obs_id", vec), 1, metric="euclidean")
    found = near.join(
        covered.select(F.col("obs_id").alias("nbr"), F.col("box").alias("_b")), "nbr"
    ).select("obs_id", "_b")
    return (
        assigned.join(found, "obs_id", "left")
        .withColumn("box", F.when(F.col("box") == -1, F.coalesce("_b", "box")).otherwise(F.col("box")))
        .drop("_b")
    )


def grid_patches(spots: DataFrame, n: int) -> DataFrame:
    """Adds ``row, col, patch`` of an n x n grid over the coordinate range."""
    lo_x, hi_x, lo_y, hi_y = (
        spots.agg(f(c)).scalar() for c in ("px", "py") for f in (F.min, F.max)
    )
    return (
        spots.withColumn("row", equal_width_bin("px", lo_x, hi_x, n))
        .withColumn("col", equal_width_bin("py", lo_y, hi_y, n))
        .withColumn("patch", F.format_string("patch_%d_%d", F.col("row"), F.col("col")))
    )


def patch_summary(patched: DataFrame, n: int) -> DataFrame:
    """``(patch, spots)`` of all n * n patches, empty ones with 0."""
    spark = patched.sparkSession
    domain = spark.range(n * n).select(
        F.format_string("patch_%d_%d", F.floor(F.col("id") / n), F.col("id") % n).alias("patch")
    )
    counted = patched.groupBy("patch").agg(F.count(F.lit(1)).alias("spots"))
    return domain.join(counted, "patch", "left").na.fill(0, ["spots"])


def grid_offset(spots: DataFrame, tile: str) -> DataFrame:
    """Adds ``gx, gy``: local tile coordinates laid out on a grid without overlap.

    Tiles go row by row in label order, ceil(sqrt(n)) per row; a tile is 1.1 times
    the whole coordinate range.
    """
    ranks = spots.select(tile).distinct().withColumn("_t", F.row_number().over(W.orderBy(tile)) - 1)
    lows = spots.groupBy(tile).agg(F.min("px").alias("_lx"), F.min("py").alias("_ly"))
    total = spots.agg(
        (F.max("px") - F.min("px")).alias("w"),
        (F.max("py") - F.min("py")).alias("h"),
        F.ceil(F.sqrt(F.countDistinct(tile))).cast("int").alias("n"),
    )
    frame = total.select(F.struct("w", "h", "n")).scalar()
    placed = ranks.join(lows, tile)
    return (
        spots.join(placed, tile)
        .withColumn("_f", frame)
        .withColumn("gx", F.col("px") - F.col("_lx") + F.pmod("_t", F.col("_f.n")) * F.col("_f.w") * TILE_GAP)
        .withColumn(
            "gy", F.col("py") - F.col("_ly") + F.floor(F.col("_t") / F.col("_f.n")) * F.col("_f.h") * TILE_GAP
        )
        .drop("_t", "_lx", "_ly", "_f")
    )


def gaussian_noise(
    counts: DataFrame, obs: DataFrame, features: DataFrame, alpha: float, seed: int = 42
) -> DataFrame:
    """``max(x + N(0, alpha * std), 0)`` over the whole dense matrix.

    The deviation counts the zeros. The draw depends on the cell and the seed only,
    so a recomputed task repeats it. ``alpha = 0`` returns the matrix unchanged.
    """
    if alpha < 0:
        raise ValueError("alpha must not be negative")
    if alpha == 0:
        return counts.select("obs_id", "feature", "x")
    n_cells = obs.count() * features.count()
    x = F.col("x").cast("double")
    own = counts.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v")).first()
    mean = (own["m"] or 0.0) * own["n"] / max(1, n_cells)
    # Squares around the mean of all cells: those of the cells there are, and of the zeros.
    squares = own["n"] * ((own["v"] or 0.0) + ((own["m"] or 0.0) - mean) ** 2) + (n_cells - own["n"]) * mean**2
    sigma = (squares / max(1, n_cells)) ** 0.5
    # Every cell gets noise, so the result is dense: each row lists all features.
    names = features.agg(F.array_sort(F.collect_set("feature"))).scalar()
    dense = obs.select("obs_id", F.explode(names).alias("feature")).join(counts, ["obs_id", "feature"], "left")
    # Box-Muller from two hashed uniforms: 13 digits of an MD5 sum each.
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("obs_id").cast("string"), "feature"))

    def uniform(part: int) -> Column:
        bits = F.conv(F.substring(digest, 1 + 13 * (part - 1), 13), 16, 10).cast("bigint")
        return (bits + 1) / F.lit(float((1 << 52) + 1))

    normal = F.sqrt(-2.0 * F.log(uniform(1))) * F.cos(2.0 * F.lit(3.141592653589793) * uniform(2))
    return dense.select(
        "obs_id",
        "feature",
        F.greatest(F.coalesce("x", F.lit(0.0)) + F.lit(alpha * sigma) * normal, F.lit(0.0)).alias("x"),
    )


BUCKET_DIGITS = 4  # of a digest: 65536 buckets a round
EXACT_ROWS = 10_000  # a last bucket of so many rows is ordered


def draw(key: str | Column, seed: int) -> Column:
    """A random place in 0..1 of a key, as the digits of an MD5 sum."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def random_subset(df: DataFrame, n: int, key: str = "obs_id", seed: int = 0) -> DataFrame:
    """The n rows of the smallest draws, ties by key: the same ones for the same seed.

    The n-th smallest draw is found from counts per leading digits, so that rows are only filtered
    and no more than ``EXACT_ROWS`` are ever ordered. Rows without a key are not drawn.
    """
    rows = df.where(F.col(key).isNotNull()).withColumn("_draw", draw(key, seed))
    known, left = "", n
    while True:
        inside = rows.where(F.col("_draw").startswith(known)) if known else rows
        digits = len(known) + BUCKET_DIGITS
        # At most 65536 counts.
        buckets = inside.groupBy(F.substring("_draw", 1, digits).alias("b")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("b")
        before = buckets["n"].cumsum()
        if not len(buckets) or before.iloc[-1] <= left:
            return rows.drop("_draw")  # no more rows than asked for
        at = int((before >= left).to_numpy().argmax())
        left -= int(before.iloc[at] - buckets["n"].iloc[at])
        known = buckets["b"].iloc[at]
        if buckets["n"].iloc[at] <= EXACT_ROWS or digits >= 32:
            break
    below = rows.where(F.substring("_draw", 1, digits) < known)
    last = rows.where(F.col("_draw").startswith(known)).orderBy("_draw", key).limit(left)
    return below.unionByName(last).drop("_draw")


def small_pair(
    sc: DataFrame, st: DataFrame, sc_obs: DataFrame, st_obs: DataFrame, n_cells: int, n_features: int, n_spots: int, n_spot_features: int, n_shared: int, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Counts of a smaller pair: the first ``n_shared`` shared features by name and the first of each
    side's own ones up to its number (the shared ones alone where a side has fewer own ones than
    ``n_shared``), and random rows that have a count in a shared feature (the reference rows: in a kept one)."""
    names = lambda counts: counts.select("feature").distinct()
    a, b = names(sc), names(st)
    # Names of features, a row each.
    first = lambda frame, n: frame.orderBy("feature").limit(max(0, n))
    shared = a.join(b, "feature", "left_semi")
    kept = first(shared, n_shared)
    own = b.join(a, "feature", "left_anti")
    keep_a = kept.unionByName(first(a.join(b, "feature", "left_anti"), n_features - n_shared))
    enough = own.limit(n_shared).count() >= n_shared
    keep_b = kept.unionByName(first(own, n_spot_features - n_shared)) if enough else first(shared, n_spot_features)
    cells = random_subset(rows_with_counts(sc_obs.select("obs_id"), sc, kept), n_cells, seed=seed)
    spots = random_subset(rows_with_counts(st_obs.select("obs_id"), st, shared), n_spots, seed=seed)

    def cut(counts: DataFrame, rows: DataFrame, features: DataFrame) -> DataFrame:
        return counts.join(rows, "obs_id", "left_semi").join(F.broadcast(features), "feature", "left_semi")

    return cut(sc, cells, keep_a), cut(st, spots, keep_b)


def median_scaled(counts: DataFrame) -> DataFrame:
    """``(obs_id, feature, y)``: rows scaled to the median total of the rows that have counts."""
    totals = counts.groupBy("obs_id").agg(F.sum("x").cast("double").alias("t")).where(F.col("t") > 0)
    # One group; a literal key would be optimised into a join of all rows with all.
    target = exact_median(totals.withColumn("_all", F.isnan("t")), ["_all"], "t").select("median").scalar()
    return counts.join(totals, "obs_id").select("obs_id", "feature", (F.col("x") / F.col("t") * target).alias("y"))


def feature_dispersion(counts: DataFrame, n_obs: DataFrame) -> DataFrame:
    """``(feature, mean, dispersion)`` over all ``n_obs`` rows, zeros included: log1p of the mean and
    log of variance / mean of the counts scaled to the median total. The dispersion of a
    feature without variance is NULL."""
    n = n_obs.scalar()
    own = median_scaled(counts).groupBy("feature").agg(F.count("y").alias("c"), F.avg("y").alias("m"), F.var_pop("y").alias("v"))
    own = own.withColumn("mean", F.col("m") * F.col("c") / n)
    squares = F.col("c") * (F.col("v") + (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))) + (n - F.col("c")) * F.col("mean") * F.col("mean")
    ratio = squares / (n - 1) / F.when(F.col("mean") == 0, F.lit(1e-12)).otherwise(F.col("mean"))
    return own.select("feature", F.log1p("mean").alias("mean"), F.log(F.when(ratio > 0, ratio)).alias("dispersion"))


def top_variable_features(stats: DataFrame, n: int, bins: int = 20, keep: DataFrame | None = None) -> DataFrame:
    """``(feature, score)``: the n features of the largest dispersion, standardised within ``bins``
    equal bins of the mean (open below, closed above). A feature alone in its bin scores 1. Features
    that tie with the n-th are kept; one without a score counts as 0.

    ``keep`` lists features that stay whatever their rank. The windows run over the
    features, one row each.
    """
    lo, hi = stats.agg(F.min("mean")).scalar(), stats.agg(F.max("mean")).scalar()
    place = F.ceil(F.try_divide(F.col("mean") - lo, (hi - lo) / bins)) - 1
    binned = stats.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.coalesce(place, F.lit(0)))))
    per = binned.groupBy("bin").agg(F.avg("dispersion").alias("_m"), F.stddev_samp("dispersion").alias("_s"), F.count("dispersion").alias("_c"))
    score = F.when(F.col("_c") == 1, F.when(F.col("dispersion").isNotNull(), F.lit(1.0))).otherwise(F.try_divide(F.col("dispersion") - F.col("_m"), F.col("_s")))
    scaled = binned.join(per, "bin").withColumn("score", score)
    # The n-th largest score, a number; features are few.
    last = scaled.where(F.col("score").isNotNull()).orderBy(F.round("score", 9).desc()).limit(n).agg(F.min(F.round("score", 9))).scalar()
    top = scaled.where(F.round(F.coalesce("score", F.lit(0.0)), 9) >= last).select("feature", "score")
    if keep is None:
        return top
    extra = keep.select("feature").join(top, "feature", "left_anti").select(
        "feature", F.lit(None).cast("double").alias("score")
    )
    return top.unionByName(extra)


def sort_names(table: DataFrame, name: str = "Name") -> DataFrame:
    """Adds ``k1, k2, k3``, the natural sort key of names like ``2_1_tissue``."""
    a, b, c = natural_key(name)
    return table.withColumn("k1", a).withColumn("k2", b).withColumn("k3", c)


def renumber(table: DataFrame, name: str = "Name", out: str = "new_id") -> DataFrame:
    """Ids 0..n-1 in natural name order."""
    return ordered_index(sort_names(table, name), ["k1", "k2", "k3", name], out)


def next_id(table: DataFrame, key: str = "PairID") -> DataFrame:
    """One row: the largest integer id + 1, or 0."""
    return table.agg((F.coalesce(F.max(F.expr(f"try_cast({key} AS BIGINT)")), F.lit(-1)) + 1).alias("next_id"))


def append_rows(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table plus the rows whose key it does not hold yet."""
    known = [c for c in rows.columns if c in table.columns]
    fresh = rows.dropDuplicates([key]).join(table.select(key), key, "left_anti").select(*known)
    return table.unionByName(fresh, allowMissingColumns=True)


def register_patches(
    index: DataFrame, pairs: DataFrame, summary: DataFrame, base: str
) -> tuple[DataFrame, DataFrame]:
    """Replaces one spatial data set by its non-empty patches in both tables.

    ``summary(patch, spots)``; the new names are ``<id>_<i>_<tissue>`` in row-major
    patch order. Pairs of the base set are repeated per patch; the result keeps the
    other pairs first and needs ``renumber`` for its ids.
    """
    m = F.split(F.lit(base), "_", 2)
    rc = [F.regexp_extract("patch", r"^patch_(\d+)_(\d+)$", g).cast("int") for g in (1, 2)]
    filled = summary.where("spots > 0").select("patch", "spots", rc[0].alias("_r"), rc[1].alias("_c"))
    numbered = ordered_index(filled, ["_r", "_c"], "_i").select(
        F.concat(m[0], F.lit("_"), (F.col("_i") + 1).cast("string"), F.lit("_"), m[1]).alias("name"),
        F.col("spots").cast("string").alias("spots"),
    )
    # The patches of one data set, a short list, repeated under each row they replace.
    patches = F.explode(numbered.agg(F.collect_list(F.struct("name", "spots"))).scalar()).alias("_p")

    def replaced(table: DataFrame, values: dict[str, str]) -> DataFrame:
        rows = table.select(*table.columns, patches)
        return rows.select(*[F.col(f"_p.{values[c]}").alias(c) if c in values else F.col(c) for c in table.columns])

    fresh = replaced(index.where(F.col("Name") == base), {"Name": "name", "SpotCount": "spots"})
    new_pairs = replaced(pairs.where(F.col("stName") == base), {"stName": "name"})
    return (
        index.where(F.col("Name") != base).unionByName(fresh),
        pairs.where(F.col("stName") != base).unionByName(new_pairs),
    )


def attach_labels(obs: DataFrame, annotation: DataFrame, key: str, label: str) -> DataFrame:
    """Left join of labels on a row key; rows without a label keep NULL."""
    ann = annotation.select(F.col(key).cast("string").alias("_k"), F.col(label).alias(label)).dropDuplicates(["_k"])
    return obs.join(ann, F.col("obs_id").cast("string") == F.col("_k"), "left").drop("_k")


def annotated_rows(obs: DataFrame, annotation: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows that are annotated, and a one-row count of annotations without a row."""
    ann = annotation.select(F.col(key).cast("string").alias("_k")).distinct()
    ids = obs.select(F.col("obs_id").cast("string").alias("_k"))
    kept = obs.join(ann, F.col("obs_id").cast("string") == F.col("_k"), "left_semi")
    missing = ann.join(ids, "_k", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return kept, missing


def attach_coordinates(obs: DataFrame, cells: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Coordinates of every row; a row without them is an error."""
    c = cells.select(F.col(key).cast("string").alias("_k"), F.col(x).alias("px"), F.col(y).alias("py"))
    out = obs.join(c, F.col("obs_id").cast("string") == F.col("_k"), "left").drop("_k")
    lost = out.where(F.col("px").isNull() | F.col("py").isNull()).count()
    if lost:
        raise ValueError(f"{lost} row(s) have no coordinates")
    return out
