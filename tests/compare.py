"""Side-by-side check of a registered query and its SQL twin."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        return repr(int(f)) if f == int(f) and abs(f) < 1e15 else f"{f:.9g}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir, name, fn, sql, con=None):
    """None when equal, otherwise a short description of the first difference."""
    con = con or duck(sf_dir)
    got = fn(spark, sf_dir)
    a = rows_of(got.columns, [tuple(r) for r in got.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    b = rows_of(names, cur.fetchall())
    if sorted(got.columns) != sorted(names):
        return f"columns {sorted(got.columns)} vs {sorted(names)}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}; spark {a[:2]} sql {b[:2]}"
    for x, y in zip(a, b):
        if x != y:
            bad = [(c, p, q) for c, p, q in zip(sorted(names), x, y) if p != q]
            n = sum(1 for p, q in zip(a, b) if p != q)
            return f"{n} of {len(a)} rows differ, first {str(bad)[:600]}"
    return None


def main(argv):
    import logging

    import __spark_entry__ as entry
    from palisade.session import local_session

    logging.disable(logging.CRITICAL)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf = "/root/testdata/sf0.01"
    wanted = [a for a in argv if not a.startswith("-")]
    if "-sf" in argv:
        sf = wanted.pop(0)
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duck(sf)
    bad = 0
    for name, fn in qs.items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            if name in sqls:
                msg = compare(spark, sf, name, fn, sqls[name], con)
                note = "ok" if msg is None else f"DIFF {msg}"
            else:
                note = f"rows-only {len(fn(spark, sf).collect())}"
                msg = None
        except Exception as ex:  # noqa: BLE001 - report and go on
            msg = note = f"ERROR {type(ex).__name__} {str(ex)[:900]}"
        bad += msg is not None
        if msg is not None or "-v" in argv or wanted:
            print(f"{time.time() - t:6.1f}s {name}: {note}", flush=True)
    print(f"{bad} bad of {len(qs)}; twins {len(sqls)}")


if __name__ == "__main__":
    main(sys.argv[1:])
