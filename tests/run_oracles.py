"""Run every registered query against its oracle:
python tests/run_oracles.py [--exact] [sf_dir] [names...]
(``--exact`` compares floats without rounding)."""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402
from oracle import compare, duck_conn  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from tillroll.session import build_session  # noqa: E402

args = sys.argv[1:]
if args and args[0] == "--exact":
    oracle.EXACT = True
    args = args[1:]
sf_dir = args[0] if args else "/root/testdata/sf0.01"
only = args[1:]
spark = build_session("local[8]", 8)
qs, ors = E.queries(), E.oracle_sql()
con = duck_conn(sf_dir)
bad = 0
for name in qs:
    if only and name not in only:
        continue
    t = time.time()
    if name not in ors:
        n = qs[name](spark, sf_dir).count()
        print(f"ROWS-ONLY {name}: {n} rows ({time.time()-t:.1f}s)")
        continue
    try:
        problems, n = compare(spark, con, name, sf_dir, qs, ors)
    except Exception as e:  # report and go on
        problems, n = [f"error: {type(e).__name__}: {str(e)[:400]}"], -1
    status = "OK " if not problems else "BAD"
    bad += bool(problems)
    print(f"{status} {name}: {n} rows ({time.time()-t:.1f}s) {' | '.join(problems)}")
print(f"{bad} failing")
