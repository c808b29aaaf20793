import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spotweave.operators import moves


def plain(n, lo, hi, codes, resolution, tolerance=1e-9):
    """Restatement of the rounds, one after the other, on Python numbers."""
    pairs = list(zip(lo, hi)) + list(zip(hi, lo))
    around = [[] for _ in range(n)]
    for a, b in pairs:
        around[b].append(a)
    deg, total, label, step = [len(x) for x in around], len(lo), list(range(n)), 0
    while True:
        volume, to, better = [0.0] * n, list(label), 0
        for v in range(n):
            volume[label[v]] += deg[v]
        for v in range(n):
            weight = {}
            for u in around[v]:
                weight[label[u]] = weight.get(label[u], 0.0) + 1.0
            gain = {c: w - resolution * deg[v] * (volume[c] - (deg[v] if c == label[v] else 0.0)) / (2.0 * total) for c, w in weight.items()}
            stay = gain.get(label[v], -resolution * deg[v] * (volume[label[v]] - deg[v]) / (2.0 * total))
            if gain and max(gain.values()) > stay + tolerance:
                better += 1
                if moves.hash_int(codes[v : v + 1], step)[0] % (2 + step // 12) == 0:
                    to[v] = max(gain, key=lambda c: (round(gain[c], 9), -int(codes[c])))
        if not better:
            return label
        label, step = to, step + 1


@pytest.fixture(scope="module")
def blocks():
    rng = np.random.default_rng(2)
    group = rng.integers(0, 9, 160)
    a, b = rng.integers(0, 160, (2, 2600))
    keep = (a < b) & ((group[a] == group[b]) | (rng.random(2600) < 0.15))
    return np.unique(np.stack([a[keep], b[keep]]), axis=1)


def test_hash_of_a_round_is_that_of_spark(spark):
    rows = spark.range(50).select(F.xxhash64("id").alias("h"), *[F.xxhash64("id", F.lit(s)).alias(f"s{s}") for s in (0, 7, 4000)]).toPandas()
    for s in (0, 7, 4000):
        assert moves.hash_int(rows["h"].to_numpy(), s).tolist() == rows[f"s{s}"].tolist()


@pytest.mark.parametrize("least", [1 << 14, 200])
def test_moves_equal_the_plain_rounds(spark, blocks, least, monkeypatch):
    monkeypatch.setattr(moves, "LEAST_EDGES", least)
    monkeypatch.setattr(moves, "KEPT_ROUNDS", 4)
    lo, hi = blocks
    both = pd.DataFrame({"u": np.concatenate([lo, hi]), "v": np.concatenate([hi, lo]), "w": 1.0})
    deg = np.bincount(both["v"], minlength=161).astype(float)  # the last node has no edge
    nodes = spark.createDataFrame(pd.DataFrame({"v": np.arange(161), "deg": deg})).withColumn("h", F.xxhash64("v"))
    codes = np.array([r["h"] for r in nodes.orderBy("v").collect()])
    got = moves.local_moves(spark.createDataFrame(both), nodes, 1.0, float(len(lo)), 1e-9)
    assert [r["label"] for r in got.orderBy("v").collect()] == plain(161, lo.tolist(), hi.tolist(), codes, 1.0)


def test_rounds_in_which_nobody_can_move_are_left_out():
    codes = np.array([5, 6], dtype=np.int64)
    turn = moves.next_turn(codes, 300)
    due = [s for s in range(300, 300 + moves.AHEAD) if any(h % (2 + s // 12) == 0 for h in moves.hash_int(codes, s).tolist())]
    assert turn == due[0] and moves.next_turn(codes[:0], 300) == 300 + moves.AHEAD
