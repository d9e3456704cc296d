"""Run registered queries against their SQL twins: python tests/check_all.py [sf] [name ...]."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import connect, difference  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from cityflux.session import local_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
only = sys.argv[2:]
spark = local_session(8)
con = connect(sf)
sql = oracle_sql()
failed = []
for name, run in queries().items():
    if only and name not in only:
        continue
    t = time.time()
    try:
        df = run(spark, sf)
        if name in sql:
            out = difference(con, sql[name], df)
        else:
            out = None if df.count() > 0 else "no rows"
        mark = "ok" if name in sql else "rows-only"
    except Exception:
        out, mark = traceback.format_exc()[-1500:], ""
    print(f"{time.time() - t:6.2f}s {name}: {'FAIL ' + out if out else mark}", flush=True)
    if out:
        failed.append(name)
print("FAILED:", failed)
sys.exit(bool(failed))
