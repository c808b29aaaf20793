"""Command line: python tests/check_oracles.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from spotweave.session import build_session  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": 8, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        try:
            out = compare(spark, con, sf, name, fn, oracles.get(name))
        except Exception as e:  # report and go on with the next query
            out = {"name": name, "ok": False, "why": f"{type(e).__name__}: {str(e)[:600]}"}
        bad += not out["ok"]
        print(("ok  " if out["ok"] else "BAD ") + str({k: v for k, v in out.items() if k != "ok"}), flush=True)
        spark.catalog.clearCache()
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
