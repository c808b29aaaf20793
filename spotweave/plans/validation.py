"""Validation of one pair and of a table of pairs, with printed reports."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from spotweave.operators import validate
from spotweave.sources import files, readers

Finding = tuple[str, str, str]  # severity, check, message


def _collect(findings: DataFrame) -> list[Finding]:
    # One row per failed check.
    return [(r["severity"], r["check"], f"{r['n']} - {r['detail']}") for r in findings.collect()]


def validate_matrix(
    spark: SparkSession, path: str, side: str, index: DataFrame | None = None
) -> tuple[list[Finding], readers.Matrix | None]:
    """Checks of one matrix; no matrix when it is missing or unreadable."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if not files.exists(spark, path):
        return [("error", "missing", f"missing data {path}")], None
    try:
        m = readers.read_matrix(spark, path)
    except AnalysisException as e:
        return [("error", "unreadable", f"cannot read {path} ({e})")], None
    parts = [validate.check_features(m.var, side), validate.check_counts(m.counts, m.obs, side)]
    if side == "st":
        parts.append(validate.check_coordinates(m.obs, side))
    extra: list[Finding] = []
    if index is not None:
        own = index.where(F.col("Name") == name)
        if not own.isEmpty():
            n_obs = m.obs.agg(F.count(F.lit(1)).alias("n"))
            n_var = m.var.agg(F.count(F.lit(1)).alias("n"))
            count_column = "CellCount" if side == "sc" else "SpotCount"
            parts.append(validate.check_index_counts(index, name, side, {count_column: n_obs, "GeneCount": n_var}))
            if side == "sc":
                parts.append(validate.check_label_keys(m.obs, own, side))
        else:
            extra.append(("warn", "index_row", f"'{name}' has no row in the index"))
    return _collect(validate.union_findings(parts)) + extra, m


def validate_pair(
    sc: readers.Matrix | None, st: readers.Matrix | None, label: str, stated: str | None = None
) -> list[Finding]:
    if sc is None or st is None:
        return [("error", "pair", f"{'reference' if sc is None else 'spatial'} data could not be loaded")]
    return _collect(validate.check_pair(sc.counts, st.counts, st.obs, label, stated))


def check_pair(
    spark: SparkSession,
    sc_path: str,
    st_path: str,
    on_subject: Callable[[str, list[Finding]], None] | None = None,
) -> dict[str, list[Finding]]:
    """Findings per subject, in the order reference, spatial, pair; prints nothing."""
    out: dict[str, list[Finding]] = {}

    def add(subject: str, found: list[Finding]) -> None:
        out[subject] = found
        if on_subject:
            on_subject(subject, found)

    found, sc = validate_matrix(spark, sc_path, "sc")
    add("sc", found)
    found, st = validate_matrix(spark, st_path, "st")
    add("st", found)
    add("pair", validate_pair(sc, st, "pair"))
    return out


def report(results: dict[str, list[Finding]]) -> int:
    """Prints the findings; exit code 1 when there is an error."""
    failed = False
    for subject, found in results.items():
        errors = sum(f[0] == "error" for f in found)
        failed |= errors > 0
        state = "ERROR" if errors else ("WARN" if found else "OK")
        print(f"{subject}: {state} (errors={errors}, warns={len(found) - errors})")
        for severity, check, message in found:
            print(f"  {severity}: {check}: {message}", file=sys.stderr if severity == "error" else sys.stdout)
    return 1 if failed else 0


def validate_single(spark: SparkSession, sc_path: str, st_path: str) -> int:
    return report(check_pair(spark, sc_path, st_path))


def validate_pairs(spark: SparkSession, pairs_csv: str, sc_dir: str | None = None, st_dir: str | None = None) -> int:
    """Every pair of a table; each data set is checked once. 2 on unusable input."""
    if not files.exists(spark, pairs_csv):
        print(f"no such file: {pairs_csv}", file=sys.stderr)
        return 2
    try:
        pairs = readers.read_pairs(spark, pairs_csv)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    home = pairs_csv.rsplit("/", 1)[0] if "/" in pairs_csv else "."
    folders = {"sc": sc_dir or f"{home}/scRNA", "st": st_dir or f"{home}/ST"}
    for folder in folders.values():
        if not files.exists(spark, folder):
            print(f"no such folder: {folder}", file=sys.stderr)
            return 2
    index = {side: readers.read_index(spark, folder) for side, folder in folders.items()}
    seen: dict[tuple[str, str], readers.Matrix | None] = {}
    results: dict[str, list[Finding]] = {}
    for row in pairs.collect():
        loaded = {}
        for side, column in (("sc", "scName"), ("st", "stName")):
            name = row[column].strip()
            if (side, name) not in seen:
                found, seen[side, name] = validate_matrix(spark, f"{folders[side]}/{name}", side, index[side])
                results[f"{side}:{name}"] = found
            loaded[side] = seen[side, name]
        stated = row["NumberSharedGenes"] if "NumberSharedGenes" in pairs.columns else None
        results[f"pair:{row['PairID']}"] = validate_pair(loaded["sc"], loaded["st"], "pair", stated)
    return report(results)
