"""SQL building blocks of the oracle queries: one CTE per intermediate table.

``with_ctes(body, names...)`` prefixes a query with the CTEs it needs, in order.
"""

from __future__ import annotations

_PAIR = {
    "sc": """SELECT obs_id, feature, SUM(x) AS x FROM (
        SELECT o_custkey AS obs_id, upper(p_brand) AS feature, l_quantity AS x
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
        UNION ALL
        SELECT o_custkey, o_orderpriority, CAST(1 AS DOUBLE)
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
    ) GROUP BY obs_id, feature""",
    "st": """SELECT obs_id, feature, SUM(x) AS x FROM (
        SELECT l_suppkey AS obs_id, upper(p_brand) AS feature, l_quantity AS x
        FROM lineitem JOIN part ON l_partkey = p_partkey
        UNION ALL
        SELECT l_suppkey, l_returnflag, CAST(1 AS DOUBLE)
        FROM lineitem JOIN part ON l_partkey = p_partkey
    ) GROUP BY obs_id, feature""",
    "sc_obs": """SELECT c_custkey AS obs_id, n_name AS label, c_mktsegment AS segment
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "st_obs": """SELECT s_suppkey AS obs_id, CAST(s_nationkey AS DOUBLE) AS px, s_acctbal AS py FROM supplier""",
    "shared": "SELECT feature FROM sc INTERSECT SELECT feature FROM st",
    "scs": """SELECT obs_id, feature, x,
        CASE WHEN SUM(x) OVER (PARTITION BY obs_id) > 0
             THEN ln(1 + 10000.0 * x / SUM(x) OVER (PARTITION BY obs_id)) ELSE 0 END AS lx
        FROM sc WHERE feature IN (SELECT feature FROM shared)""",
    "sts": """SELECT obs_id, feature, x,
        CASE WHEN SUM(x) OVER (PARTITION BY obs_id) > 0
             THEN ln(1 + 10000.0 * x / SUM(x) OVER (PARTITION BY obs_id)) ELSE 0 END AS lx
        FROM st WHERE feature IN (SELECT feature FROM shared)""",
    "codes": """SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS c
        FROM (SELECT DISTINCT label FROM sc_obs WHERE label IS NOT NULL)""",
    "start": "SELECT obs_id, c, label FROM sc_obs JOIN codes USING (label)",
    "sizes": "SELECT c, count(*) AS n FROM start GROUP BY c",
    "sums": """SELECT c, feature, SUM(x) AS sx, SUM(lx) AS slx
        FROM scs JOIN start USING (obs_id) GROUP BY c, feature""",
    "centroids": """SELECT z.c, f.feature, COALESCE(sx, 0) AS sx, COALESCE(slx, 0) AS slx,
            CASE WHEN COALESCE(t.total, 0) = 0 THEN 1e-6 ELSE COALESCE(sx, 0) / (n + 1e-8) END AS m,
            COALESCE(slx, 0) / (n + 1e-8) AS ml
        FROM sizes z CROSS JOIN shared f
        LEFT JOIN sums s ON s.c = z.c AND s.feature = f.feature
        LEFT JOIN (SELECT c, SUM(sx) AS total FROM sums GROUP BY c) t ON t.c = z.c
        WHERE sx IS NOT NULL OR COALESCE(t.total, 0) = 0""",
    "ks": "SELECT CAST(unnest(range(1, (SELECT max(c) + 2 FROM sizes))) AS INTEGER) AS k",
    "cut": "SELECT k, c, CAST(c % k AS INTEGER) AS state FROM ks CROSS JOIN sizes",
    "state_sizes": "SELECT k, state, SUM(n) AS n FROM cut JOIN sizes USING (c) GROUP BY k, state",
    "profiles": """SELECT k, state, feature, SUM(sx) / (any_value(z.n) + 1e-8) AS m,
            SUM(slx) / (any_value(z.n) + 1e-8) AS ml
        FROM sums JOIN cut USING (c) JOIN state_sizes z USING (k, state) GROUP BY k, state, feature""",
    "state_norms": """SELECT k, state, sqrt(SUM(m * m)) AS norm, SUM(ml * ml) AS ml2, SUM(m * m) AS m2
        FROM profiles GROUP BY k, state""",
    "spot_norms": """SELECT o.obs_id, COALESCE(SUM(x * x), 0) AS nn, COALESCE(SUM(lx * lx), 0) AS ln
        FROM st_obs o LEFT JOIN sts USING (obs_id) GROUP BY o.obs_id""",
    "dots": """SELECT k, obs_id, state, SUM(x * m) AS dot, SUM(lx * ml) AS ldot
        FROM sts JOIN profiles USING (feature) GROUP BY k, obs_id, state""",
    "scores": """SELECT z.k, z.state, s.obs_id, COALESCE(dot, 0) AS dot, COALESCE(ldot, 0) AS ldot, nn, ln,
            COALESCE(norm, 0) AS norm, COALESCE(m2, 0) AS m2, COALESCE(ml2, 0) AS ml2,
            COALESCE(dot, 0) / ((sqrt(nn) + 1e-8) * (COALESCE(norm, 0) + 1e-8)) AS sim
        FROM state_sizes z CROSS JOIN spot_norms s
        LEFT JOIN state_norms USING (k, state)
        LEFT JOIN dots d ON d.k = z.k AND d.state = z.state AND d.obs_id = s.obs_id""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY k, obs_id ORDER BY round(sim, 9) DESC, state) AS rn
        FROM scores""",
    "nearest": """SELECT k, obs_id, max(CASE WHEN rn = 1 THEN state END) AS state,
            max(CASE WHEN rn = 1 THEN sim END) AS sim,
            CASE WHEN k = 1 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - (1 - max(CASE WHEN rn = 1 THEN sim END))
                / (avg(CASE WHEN rn BETWEEN 2 AND 4 THEN 1 - sim END) + 1e-8))) END AS confidence
        FROM ranked GROUP BY k, obs_id""",
    "spatial_edges": """SELECT a.obs_id AS src, b.obs_id AS dst FROM st_obs a CROSS JOIN st_obs b
        WHERE a.obs_id <> b.obs_id
        QUALIFY row_number() OVER (PARTITION BY a.obs_id ORDER BY
            round(sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)), 9), b.obs_id) <= 6""",
    "vec": """SELECT vec_id AS obs_id, label AS c, CAST(embedding AS DOUBLE[]) AS v,
            sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) + 1e-8 AS n
        FROM embeddings""",
    "ref": "SELECT * FROM vec",
    "qry": "SELECT * FROM vec",
}
_NEEDS = {
    "shared": ["sc", "st"],
    "scs": ["sc", "shared"],
    "sts": ["st", "shared"],
    "codes": ["sc_obs"],
    "start": ["sc_obs", "codes"],
    "sizes": ["start"],
    "sums": ["scs", "start"],
    "centroids": ["sizes", "shared", "sums"],
    "ks": ["sizes"],
    "cut": ["ks", "sizes"],
    "state_sizes": ["cut", "sizes"],
    "profiles": ["sums", "cut", "state_sizes"],
    "state_norms": ["profiles"],
    "spot_norms": ["st_obs", "sts"],
    "dots": ["sts", "profiles"],
    "scores": ["state_sizes", "spot_norms", "state_norms", "dots"],
    "ranked": ["scores"],
    "nearest": ["ranked"],
    "spatial_edges": ["st_obs"],
    "ref": ["vec"],
    "qry": ["vec"],
}


def define(name: str, needs: list[str], sql: str) -> None:
    """Adds a CTE that other queries can name."""
    _PAIR[name] = sql
    _NEEDS[name] = needs


# The tree by its definition: at every step, the two groups whose leaves are nearest on average, or
# (ward.D) whose union adds most to the distances within.
define("profile_freq", ["centroids"], "SELECT c, feature, m / (SUM(m) OVER (PARTITION BY c) + 1e-8) AS f FROM centroids")
define(
    "leaf_distances",
    ["profile_freq", "sizes", "shared"],
    """SELECT a.c AS a, b.c AS b,
            sqrt(SUM((COALESCE(fa.f, 0) - COALESCE(fb.f, 0)) * (COALESCE(fa.f, 0) - COALESCE(fb.f, 0)))) AS d
        FROM sizes a CROSS JOIN sizes b CROSS JOIN shared s
        LEFT JOIN profile_freq fa ON fa.c = a.c AND fa.feature = s.feature
        LEFT JOIN profile_freq fb ON fb.c = b.c AND fb.feature = s.feature
        GROUP BY a.c, b.c""",
)
_WITHIN = """(SELECT method, tops[a + 1] AS x, avg(d) AS mean, sqrt(count(*)) AS n
                      FROM tree_walk, leaf_distances WHERE tops[a + 1] = tops[b + 1] GROUP BY ALL)"""
define(
    "tree_walk",
    ["leaf_distances"],
    f"""SELECT method, 0 AS step, (SELECT list(c ORDER BY c) FROM sizes) AS tops FROM (VALUES ('average'), ('ward')) v(method)
        UNION ALL
        SELECT method, step + 1, list_transform(tops, lambda x: CASE WHEN x = hi THEN lo ELSE x END)
        FROM (
            SELECT *, row_number() OVER (PARTITION BY method ORDER BY CASE method WHEN 'average' THEN apart
                ELSE 2 * n_lo * n_hi / (n_lo + n_hi) * (apart - in_lo / 2 - in_hi / 2) END, lo, hi) AS rn
            FROM (
                SELECT p.method, p.step, p.tops, p.x AS lo, p.y AS hi, p.mean AS apart,
                    q.mean AS in_lo, r.mean AS in_hi, q.n AS n_lo, r.n AS n_hi
                FROM (SELECT method, step, tops, tops[a + 1] AS x, tops[b + 1] AS y, avg(d) AS mean
                      FROM tree_walk, leaf_distances WHERE step < len(tops) - 1 GROUP BY ALL) p
                JOIN {_WITHIN} q ON q.method = p.method AND q.x = p.x
                JOIN {_WITHIN} r ON r.method = p.method AND r.x = p.y
                WHERE p.x < p.y))
        WHERE rn = 1""",
)
define(
    "tree_cut",
    ["tree_walk"],
    """SELECT method, CAST(len(tops) - step AS INTEGER) AS k, CAST(c AS INTEGER) AS c,
            CAST(dense_rank() OVER (PARTITION BY method, step ORDER BY tops[c + 1]) - 1 AS INTEGER) AS state
        FROM (SELECT method, step, tops, unnest(range(len(tops))) AS c FROM tree_walk)""",
)
define(
    "tree_profiles",
    ["sums", "tree_cut", "sizes"],
    """SELECT k, state, feature, SUM(sx) / (any_value(z.n) + 1e-8) AS m
        FROM sums JOIN (SELECT k, c, state FROM tree_cut WHERE method = 'average') USING (c)
        JOIN (SELECT k, state, SUM(n) AS n FROM tree_cut JOIN sizes USING (c) WHERE method = 'average' GROUP BY k, state) z
            USING (k, state)
        GROUP BY k, state, feature""",
)
define(
    "tree_scores",
    ["tree_profiles", "spot_norms"],
    """SELECT z.k, z.state, s.obs_id, COALESCE(dot, 0) AS dot, nn, norm * norm AS m2,
            COALESCE(dot, 0) / ((sqrt(nn) + 1e-8) * (norm + 1e-8)) AS sim
        FROM (SELECT k, state, sqrt(SUM(m * m)) AS norm FROM tree_profiles GROUP BY k, state) z
        CROSS JOIN spot_norms s
        LEFT JOIN (SELECT k, obs_id, state, SUM(x * m) AS dot FROM sts JOIN tree_profiles USING (feature) GROUP BY ALL) d
            ON d.k = z.k AND d.state = z.state AND d.obs_id = s.obs_id""",
)

# Label shuffles: the row numbers of the spots run through six Feistel rounds, again while they lie
# outside 0..n-1. A row of the walk is one round.
_M32 = 4294967295


def mix_sql(value: str, key: str) -> str:
    """The 32-bit mix of nulls.py; one pass of a list reduction per step."""
    first = f"(({value})::UBIGINT * 2654435761::UBIGINT + ({key})::UBIGINT) & {_M32}::UBIGINT"
    step = "(xor(z, z >> (s >> 32)) * (s & 4294967295::UBIGINT)) & 4294967295::UBIGINT"
    steps = f"[{(15 << 32) + 2246822519}::UBIGINT, {(13 << 32) + 3266489917}::UBIGINT, {(16 << 32) + 1}::UBIGINT]"
    return f"list_reduce(list_concat([{first}], {steps}), lambda z, s: {step})"


define("shuffle_n", ["st_obs"], "SELECT count(*) AS n, greatest(1, (length(bin(greatest(1, count(*) - 1))) + 1) // 2) AS half FROM st_obs")
define("spot_index", ["st_obs"], "SELECT obs_id, row_number() OVER (ORDER BY obs_id) - 1 AS i FROM st_obs")
define(
    "shuffle_keys",
    [],
    f"""SELECT draw, r, {mix_sql('draw * 6 + r', mix_sql('0', '1'))} AS key
        FROM range(100) a(draw), range(6) b(r)""",
)
define(
    "shuffle_walk",
    ["shuffle_n", "spot_index", "shuffle_keys"],
    f"""SELECT i, draw, 0 AS round, i::UBIGINT >> half AS l, i::UBIGINT & ((1 << half) - 1)::UBIGINT AS r
        FROM spot_index, shuffle_n, range(100) a(draw)
        UNION ALL
        SELECT i, w.draw, round + 1, w.r, xor(l, {mix_sql('w.r', 'key')} & ((1 << half) - 1)::UBIGINT)
        FROM shuffle_walk w JOIN shuffle_keys k ON k.draw = w.draw AND k.r = w.round % 6, shuffle_n
        WHERE round % 6 <> 0 OR round = 0 OR (l << half) + w.r >= n""",
)
define(
    "shuffle_places",
    ["shuffle_walk", "shuffle_n", "spot_index"],
    """SELECT obs_id, w.draw, ((l << half) + r)::BIGINT AS place
        FROM shuffle_walk w JOIN spot_index USING (i), shuffle_n
        WHERE round > 0 AND round % 6 = 0 AND (l << half) + r < n""",
)
define(
    "shuffle_bounds",
    ["nearest"],
    """SELECT k, state, SUM(n) OVER (PARTITION BY k ORDER BY state) - n AS low, SUM(n) OVER (PARTITION BY k ORDER BY state) AS high
        FROM (SELECT k, state, count(*) AS n FROM nearest GROUP BY k, state)""",
)
define(
    "shuffled_labels",
    ["shuffle_places", "shuffle_bounds"],
    "SELECT k, draw, obs_id, state FROM shuffle_places JOIN shuffle_bounds ON place >= low AND place < high",
)


def with_ctes(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, []):
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({_PAIR[n]})" for n in order)
    recursive = "RECURSIVE " if {"tree_walk", "shuffle_walk"} & set(order) else ""
    return f"WITH {recursive}{parts}\n{body}"


def r6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"
