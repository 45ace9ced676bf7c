"""python tests/check_all.py [SF] [NAME...]: compares queries with their SQL and prints the time each took."""

import sys
import time

sys.path[:0] = ["/root/repo", "/root/repo/tests"]

import __spark_entry__ as entry  # noqa: E402
from oracle import TABLES_AT, compare, connect  # noqa: E402

from lakeloom.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf, names = (sys.argv[1] if len(sys.argv) > 1 else "sf0.01"), sys.argv[2:]
    spark, d = local_session(), f"{TABLES_AT}/{sf}"
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = connect(d), entry.queries(), entry.oracle_sql()
    for name in queries:
        if names and not any(name.startswith(n) for n in names):
            continue
        began = time.time()
        try:
            said = compare(spark, con, d, queries[name], sql[name]) or "ok" if name in sql else f"{queries[name](spark, d).count()} rows, no SQL"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
