"""Run registered queries against their oracles: run_oracles.py [sf] [name…]"""

import sys
import time

sys.path.insert(0, ".")
from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tests.conftest import make_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
names = sys.argv[2:]
d = f"/root/testdata/sf{sf}"
spark, con = make_session(), connect(d)
qs, sql = queries(), oracle_sql()
bad = 0
for name in (names or qs):
    t = time.time()
    try:
        df = qs[name](spark, d)
        said = compare(df, con, sql[name]) if name in sql else f"rows {df.count()}"
        ok = said is None or name not in sql
    except Exception as e:  # noqa: BLE001
        said, ok = f"{type(e).__name__}: {str(e)[:600]}", False
    bad += not ok
    print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - t:.1f}s {said or ''}", flush=True)
print("failures:", bad, "of", len(names or qs))
