"""Run registered queries against their DuckDB oracles.

usage: python check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import json
import sys
import time

from relflow.plans.oracle import compare, duck
from relflow.queries import ORACLES, QUERIES
from relflow.session import get_spark


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(QUERIES)
    spark = get_spark()
    con = duck(sf)
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = QUERIES[n](spark, sf)
            if n in ORACLES:
                r = compare(df, con, ORACLES[n])
                r["values_match"] = r["values_match"] and not r["type_mismatches"]
            else:
                r = {"rows": df.count(), "values_match": None}
        except Exception as e:  # report and go on
            r = {"error": str(e).splitlines()[0][:400], "values_match": False}
        r["sec"] = round(time.time() - t, 2)
        ok = r.get("values_match")
        bad += ok is False
        print(("OK  " if ok else ("ROWS" if ok is None else "FAIL")), n, json.dumps(r, default=str)[:900], flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
