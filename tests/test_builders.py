import pytest

from spotweave.plans import builders


def test_regional_reference(spark, tmp_path):
    regions = {}
    for tag, label in (("V", "x"), ("A", "none")):
        files = {
            "exon": f"key,{tag}1,{tag}2\n10,1,0\n11,2,3\n",
            "intron": f"key,{tag}1,{tag}2\n10,1,0\n11,0,1\n",
            "rows": "gene_symbol,entrez\nabc,10\nABC,11\n",
            "samples": f"sample,cluster\n{tag}1,{label}\n{tag}2,y\n",
        }
        for name, text in files.items():
            (tmp_path / f"{tag}_{name}.csv").write_text(text)
        regions[tag] = {name: f"{tmp_path}/{tag}_{name}.csv" for name in files}
    counts, obs = builders.regional_reference(spark, regions)
    assert {r["obs_id"]: r["label"] for r in obs.collect()} == {"V_V1": "x", "V_V2": "y", "A_A2": "y"}
    assert {(r["obs_id"], r["feature"]): r["x"] for r in counts.collect()} == {("V_V1", "ABC"): 4, ("V_V2", "ABC"): 4, ("A_A2", "ABC"): 4}


def test_spatial_builders(spark):
    counts = spark.createDataFrame([(1, "a", 2.0), (2, "A", 1.0), (3, "ctl", 9.0)], "obs_id bigint, feature string, x double")
    cells = spark.createDataFrame(
        [(1, 0, "in", 0.0, 0.0), (2, 1, "in", 5.0, 10.0), (3, 1, "out", 1.0, 1.0)], "obs_id bigint, fov int, region string, px double, py double"
    )
    got, obs = builders.tiled_spatial(counts, cells, "fov", ("region", "in"))
    assert {(r["obs_id"], r["feature"]) for r in got.collect()} == {(1, "A"), (2, "A")}
    # Two tiles in one row; a tile is 1.1 times the range of 5.
    assert {r["obs_id"]: (r["px"], r["py"]) for r in obs.collect()} == {1: (0.0, 0.0), 2: (pytest.approx(5.5), 0.0)}

    var = spark.createDataFrame([("a", "Gene Expression"), ("A", "Gene Expression"), ("ctl", "Control")], "feature string, feature_types string")
    where = spark.createDataFrame([("1", 0.1, 0.2), ("2", 0.3, 0.4)], "cell_id string, x double, y double")
    two = spark.createDataFrame([(1,), (2,)], "obs_id bigint")
    got, obs = builders.panel_spatial(counts, var, two, where, "cell_id", "x", "y")
    assert got.where("feature = 'CTL'").count() == 0 and obs.count() == 2

    ann = spark.createDataFrame([("1", "t"), ("9", "t")], "barcode string, kind string")
    got, obs, missing = builders.annotated_reference(counts, two, ann, "barcode", "kind")
    assert [r["kind"] for r in obs.collect()] == ["t"] and missing.first()["missing"] == 1 and got.count() == 1
