"""Compare registered queries with their oracles at a scale factor: check.py [sf] [name...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from ensspark.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    queries, oracles = contract.queries(), contract.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        started = time.time()
        try:
            if name in oracles:
                n = compare(spark, con, queries[name], oracles[name], sf_dir)
            else:
                n = queries[name](spark, sf_dir).count()
            print(f"ok   {name:28s} {n:8d} rows {time.time() - started:6.2f}s", flush=True)
        except Exception as error:
            failed += 1
            print(f"FAIL {name:28s} {str(error)[:1500]}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
