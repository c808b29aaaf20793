import pytest

from spotweave import cli


@pytest.mark.parametrize(
    "argv",
    [
        [],
        ["run"],
        ["run", "--scdata", "a", "--stdata", "b"],
        ["run", "--pairs_csv", "p", "--sc_dir", "a"],
        ["run", "--linkage_method", "single"],
        ["validate"],
        ["validate", "--pairs_csv", "p", "--scdata", "a"],
        ["validate", "--scdata", "a", "--stdata", "b", "--sc_dir", "c"],
        ["unknown"],
        ["run", "--scdata", "a", "--stdata", "b", "--output_dir", "c", "--mapping", "no_such"],
        ["run", "--scdata", "a", "--stdata", "b", "--output_dir", "c", "--aligner", "x=no_such_module:f"],
    ],
)
def test_misuse_exits_with_2(argv):
    with pytest.raises(SystemExit) as e:
        cli.main(argv)
    assert e.value.code == 2


def test_defaults():
    args = cli.parser().parse_args(["run"])
    assert (args.mapping, args.leiden_resolution, args.linkage_method, args.k_step) == ("nearest_centroid", 3.0, "average", 1)
    assert args.k_min is None and args.k_max is None and args.start_from_annotation is None


def test_version(capsys):
    with pytest.raises(SystemExit) as e:
        cli.main(["--version"])
    assert e.value.code == 0
