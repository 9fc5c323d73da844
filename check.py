"""Run the catalogue's queries against their SQL twins: ``python check.py [prefix ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from catalogue import entries
from session import make_session

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T00:00:00", "")
    if isinstance(v, (list, tuple)):
        return [cell(x) for x in v]
    if type(v).__name__ == "Decimal":
        return repr(float(v))
    return repr(v)


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        tuple(str(cell(r[i])) for i in order) for r in rows
    )


def main(argv):
    spark = make_session("check")
    con = duckdb.connect()
    for f in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(f)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f}'")
    bad = 0
    for name, entry in entries().items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        t = time.time()
        try:
            df = entry.run(spark, SF_DIR)
            got = normal(df.columns, df.collect())
        except Exception as exc:
            bad += 1
            print(f"FAIL {name}: {type(exc).__name__} {str(exc)[:700]}", flush=True)
            continue
        spent = time.time() - t
        if entry.sql is None:
            print(f"rows {name}: {len(got[1])} rows, {spent:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(entry.sql)
            cols = [d[0] for d in cur.description]
            want = normal(cols, cur.fetchall())
        except Exception as exc:
            bad += 1
            print(f"FAIL {name}: SQL {str(exc)[:700]}", flush=True)
            continue
        if got == want:
            types = dict(zip(cols, [str(d[1]) for d in cur.description]))
            print(f"ok   {name}: {len(got[1])} rows, {spent:.1f}s "
                  + (str({c: (df.schema[c].dataType.simpleString(), types[c]) for c in cols})
                     if "-v" in sys.argv else ""), flush=True)
            continue
        bad += 1
        print(f"DIFF {name}: {len(got[1])} vs {len(want[1])} rows, {got[0]} vs {want[0]}", flush=True)
        a, b = set(got[1]), set(want[1])
        for label, only in (("spark", a - b), ("sql", b - a)):
            for row in sorted(only)[:3]:
                print("    ", label, row)
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main([a for a in sys.argv[1:] if a != "-v"])))
