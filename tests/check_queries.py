"""Run queries against their SQL: ``python tests/check_queries.py SF_DIR [name ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import connect, difference  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from ledgerlight.session import build_session  # noqa: E402


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    failed = 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        begin = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                note = ""
            else:
                problem, note = None, f" rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001
            problem, note = f"{type(error).__name__}: {str(error)[:600]}", ""
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok'} {name} {time.time() - begin:.1f}s{note} {problem or ''}", flush=True)
    print("failed:", failed)


main()
