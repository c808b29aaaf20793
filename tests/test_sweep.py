"""End to end on the smallest data: layout, properties of the results, cache, reports."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from spotweave.operators import mappers
from spotweave.plans import sweep, validation
from spotweave.sources import readers, tables, writers

TABLES = (
    "assignment coherence coherence_summary cossim_gene cossim_spot cossim_summary cut mapping modularity "
    "onehot onehot_summary start_clustering topology k_comparison"
).split()


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sweep"))
    writers.write_matrix(tables.customer_counts(spark, SF), tables.customer_rows(spark, SF), f"{d}/scRNA/cust")
    writers.write_matrix(tables.supplier_counts(spark, SF), tables.supplier_rows(spark, SF), f"{d}/ST/supp")
    (d_pairs := f"{d}/pairs.csv")
    with open(d_pairs, "w") as f:
        f.write("PairID,scName,stName\n0,cust,supp\n1,cust,absent\n")
    return d


def test_batch_reports_missing_and_sweeps_the_rest(spark, root):
    config = sweep.SweepConfig(start_from_annotation="segment")
    jobs = sweep.run_batch(spark, f"{root}/pairs.csv", f"{root}/scRNA", f"{root}/ST", f"{root}/out", config)
    assert {(r["pair"], r["status"]) for r in jobs.collect()} == {(0, "done"), (1, "missing")}
    assert "absent" in jobs.where("pair = 1").first()["detail"]
    out = f"{root}/out/000_cust__supp"
    run = f"{out}/nearest_centroid"
    for name in TABLES:
        assert spark.read.parquet(f"{run}/{name}").count() > 0, name
    assert readers.list_mappers(spark, out) == ["nearest_centroid"]
    assert readers.list_ks(spark, run) == readers.all_ks(spark, out) == [1, 2, 3, 4, 5]
    assert readers.read_config(spark, run)["start_from_annotation"] == "segment"
    names = [r["name"] for r in spark.read.parquet(f"{run}/start_clustering").select("c", "name").distinct().orderBy("c").collect()]
    assert names == sorted(names) and len(names) == 5

    mapping = spark.read.parquet(f"{run}/mapping")
    sums = mapping.groupBy("k", "obs_id").agg(F.sum("p").alias("s"))
    assert sums.where("abs(s - 1) > 1e-9").count() == 0
    table = {r["k"]: r for r in readers.read_k_table(spark, run).collect()}
    assert table[1]["mean_confidence"] == 1.0 and table[1]["modularity_shared"] == pytest.approx(0.0)
    hard = spark.read.parquet(f"{run}/assignment").where("k = 1").select("state").distinct().collect()
    assert [r["state"] for r in hard] == [0]
    soft, _ = readers.read_mapping(spark, run, 3)
    assert soft.select("k").distinct().count() == 1
    # A one-hot mapping predicts the same hard and soft.
    c = spark.read.parquet(f"{run}/cossim_spot").groupBy("k", "obs_id").pivot("combo").agg(F.first("value"))
    assert c.where("abs(`soft-raw` - `hard-raw`) > 1e-9 OR abs(`soft-norm` - `hard-norm`) > 1e-9").count() == 0


def test_external_aligner_and_cached_scaffold(spark, root):
    """A registered function that gives every spot to the last state, on the same scaffold."""
    seen = []

    def last_state(pair, k, cells):
        seen.append((k, cells.select("state").distinct().count()))
        return pair.st_obs.select("obs_id", F.lit(k - 1).alias("state"), F.lit(2.0).alias("p"))

    mappers.register_aligner("dot", last_state)
    out = f"{root}/out/000_cust__supp"
    config = sweep.SweepConfig(mapping="dot", start_from_annotation="segment", k_min=1, k_max=2)
    scored = sweep.run_pair(spark, f"{root}/scRNA/cust", f"{root}/ST/supp", out, config).collect()
    assert seen == [(2, 2)]
    assert [r["k"] for r in scored] == [1, 2]
    assert all(r["mean_confidence"] is None or r["mean_confidence"] != r["mean_confidence"] for r in scored)
    run = f"{out}/dot"
    assert spark.read.parquet(f"{run}/mapping").where("k = 2").count() == 20
    assert {r["state"] for r in spark.read.parquet(f"{run}/assignment").where("k = 2").collect()} == {1}


def test_sweep_from_communities(spark, root):
    """The default mode: start clusters come from the graph, not from a label."""
    out = f"{root}/communities"
    config = sweep.SweepConfig(mapping="wann", linkage_method="ward")
    scored = sweep.run_pair(spark, f"{root}/scRNA/cust", f"{root}/ST/supp", out, config).collect()
    run = f"{out}/wann"
    start = spark.read.parquet(f"{run}/start_clustering")
    n = start.select("c").distinct().count()
    assert [r["k"] for r in scored] == list(range(1, n + 1))
    cut = spark.read.parquet(f"{run}/cut")
    assert all(r["n"] == r["k"] for r in cut.groupBy("k").agg(F.count_distinct("state").alias("n")).collect())
    sums = spark.read.parquet(f"{run}/mapping").groupBy("k", "obs_id").agg(F.sum("p").alias("s"))
    assert sums.where("abs(s - 1) > 1e-9").count() == 0
    spots = spark.read.parquet(f"{run}/cossim_spot")
    assert spots.where("value < -1 OR value > 1").count() == 0 and spots.select("combo").distinct().count() == 4
    assert all(r["n_states"] <= r["k"] for r in spark.read.parquet(f"{run}/topology").collect())


def test_a_failed_cache_write_does_not_end_the_sweep(spark, root, monkeypatch):
    """The scaffold is that of the first sweep, which is built no second time here."""
    keys, read = [], writers.read_scaffold

    def remembered(spark, out, key):
        keys.append(key)
        return read(spark, out, key)

    def broken(*args):
        raise OSError("no space")

    monkeypatch.setattr(writers, "read_scaffold", remembered)
    monkeypatch.setattr(writers, "write_scaffold", broken)
    monkeypatch.setattr(sweep, "build_scaffold", lambda *args: read(spark, f"{root}/out/000_cust__supp", keys[-1]))
    config = sweep.SweepConfig(start_from_annotation="segment", k_max=2)
    scored = sweep.run_pair(spark, f"{root}/scRNA/cust", f"{root}/ST/supp", f"{root}/uncached", config).collect()
    assert [r["k"] for r in scored] == [1, 2] and len(keys) == 1


def test_validation_of_a_table_of_pairs(spark, root, capsys):
    code = validation.validate_pairs(spark, f"{root}/pairs.csv")
    text = capsys.readouterr()
    assert code == 1 and "absent" in text.err and "sc:cust: OK" in text.out
    assert validation.validate_pairs(spark, f"{root}/none.csv") == 2
    assert validation.validate_single(spark, f"{root}/scRNA/cust", f"{root}/ST/supp") == 0
