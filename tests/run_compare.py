"""python tests/run_compare.py [sf dir] [name ...]: compare queries with their SQL twins."""

from __future__ import annotations

import importlib
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.compare import differences, oracle  # noqa: E402
from tidewatt.plans.registry import CATALOG  # noqa: E402
from tidewatt.session import build_session  # noqa: E402


def main() -> None:
    folder, wanted = sys.argv[1], sys.argv[2:]
    for module in ("panel", "calendar", "weather", "source", "diagnosis", "evaluation", "model", "streaming"):
        try:
            importlib.import_module(f"tidewatt.plans.{module}_queries")
        except ModuleNotFoundError as missing:
            print("skip", missing)
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.log.level": "ERROR"})
    con = oracle(folder)
    bad = 0
    for name, q in CATALOG.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        try:
            df = q.plan(spark, folder)
            if q.sql is None:
                rows = df.collect()
                verdict = f"rows {len(rows)} {rows[:1]}"
            else:
                verdict = differences(df, con, q.sql)
        except Exception as error:
            verdict = "ERROR " + (str(error)[:1500] if not os.environ.get("TRACE") else traceback.format_exc())
        ok = verdict is None or q.sql is None and verdict.startswith("rows")
        bad += not ok
        print(f"{'ok  ' if ok else 'BAD '} {name:28s} {time.time() - t:6.2f}s {verdict or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
