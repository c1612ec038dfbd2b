"""Run registered queries against their SQL on one scale: python tests/check_queries.py [sf_dir] [names...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract
from tests.compare import compare, oracle_connection
from tastelake.session import build_session

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = oracle_connection(sf_dir), contract.oracle_sql()
    bad = []
    for name, fn in contract.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            result = fn(spark, sf_dir).toPandas()
            problem = compare(result, con.execute(sql[name]).df()) if name in sql else f"rows only: {len(result)}"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        ok = problem is None or problem.startswith("rows only")
        bad += [] if ok else [name]
        print(f"{'ok  ' if ok else 'BAD '} {name:28s} {time.time() - started:6.1f}s {problem or ''}", flush=True)
    print("bad:", bad)
