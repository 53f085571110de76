"""Command line: compare chosen queries (prefixes or names) with DuckDB.

python tests/run_check.py [sf] [name-prefix ...]
"""

import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/", 2)[0])
import __spark_entry__ as entry  # noqa: E402
from tests.compare import compare, connect  # noqa: E402
from tilewright.fixtures import TABLES  # noqa: E402
from tilewright.session import local_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
wanted = sys.argv[2:]
sf_dir = f"/root/testdata/sf{sf}"
spark = local_session()
spark.sparkContext.setLogLevel("ERROR")
con = connect(sf_dir, TABLES)
queries, oracles = entry.queries(), entry.oracle_sql()
bad = []
for name, fn in queries.items():
    if wanted and not any(name.startswith(w) for w in wanted):
        continue
    start = time.time()
    try:
        frame = fn(spark, sf_dir)
        if name in oracles:
            ok, message = compare(frame, con, oracles[name])
        else:
            rows = frame.collect()
            ok, message = True, f"{len(rows)} rows, no SQL"
            if not rows:
                message += " EMPTY"
        if ok and message.startswith("0 rows"):
            message += " EMPTY"
    except Exception as error:  # noqa: BLE001
        ok, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        if "-v" in sys.argv:
            traceback.print_exc()
    if not ok:
        bad.append(name)
    print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {time.time() - start:6.2f}s  {message}", flush=True)
print(f"{len(bad)} failed: {bad}")
sys.stdout.flush()
