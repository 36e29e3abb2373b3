"""Run queries next to their SQL twins: python -m tests.oracle_check [--sf DIR] [name-prefix ...]"""

from __future__ import annotations

import argparse
import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    import datetime
    import decimal

    if v is None:
        return ("0",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, int):
        return ("n", float(v))
    if isinstance(v, float):
        return ("0",) if math.isnan(v) else ("n", v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return ("t", str(v))
    if isinstance(v, (list, tuple)):
        return ("l", str([_norm(x) for x in v]))
    return ("s", str(v))


def _key(row):
    return tuple((c[0], round(c[1], 4) if c[0] == "n" else c[1:]) for c in row)


def _same(a, b) -> bool:
    if a[0] != b[0]:
        return False
    if a[0] == "n":
        return math.isclose(a[1], b[1], rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def kind(t: str) -> str:
    t = t.lower()
    if t in ("tinyint", "smallint", "int", "integer", "bigint", "hugeint", "ubigint"):
        return t.replace("integer", "int")
    return {"varchar": "string"}.get(t, t)


def compare(df, con, oracle: str) -> str | None:
    """None if equal, else what differs."""
    cols = sorted(df.columns)
    rel = con.sql(oracle)
    names = list(rel.columns)
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    types = dict(zip(names, map(str, rel.types)))
    mine = dict(df.dtypes)
    notes = [f"{c}:{mine[c]}/{types[c]}" for c in cols if kind(mine[c]) != kind(types[c])]
    got = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    at = [names.index(c) for c in cols]
    want = [tuple(_norm(r[i]) for i in at) for r in con.execute(oracle).fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got.sort(key=_key)
    want.sort(key=_key)
    bad = [(g, w) for g, w in zip(got, want) if not all(_same(a, b) for a, b in zip(g, w))]
    if bad:
        g, w = bad[0]
        diff = [(c, a, b) for c, a, b in zip(cols, g, w) if not _same(a, b)]
        return f"{len(bad)} of {len(got)} rows differ, first: {diff}"
    return f"types {notes}" if notes else None


def main(argv=None) -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--skip-ok", action="store_true")
    ap.add_argument("--module", action="append", default=[], help="only queries of these modules")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args(argv)
    import __spark_entry__ as entry
    from winnow.session import get_spark

    spark = get_spark("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                            "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    qs, sq = entry.queries(), entry.oracle_sql()
    con = duck(a.sf)
    failed = 0
    for n, fn in qs.items():
        if a.names and not any(n.startswith(x) for x in a.names):
            continue
        if a.module and fn.__module__.rsplit(".", 1)[-1] not in a.module:
            continue
        t0 = time.time()
        try:
            df = fn(spark, a.sf)
            if n in sq:
                msg = compare(df, con, sq[n])
            else:
                k = df.count()
                msg = None if k else "no rows"
                n += f" [rows {k}]"
        except Exception as e:
            msg = "".join(str(e).split("JVM stacktrace")[0])[:600]
        ok = msg is None
        failed += not ok
        if not ok or not a.skip_ok:
            print(f"{'ok  ' if ok else 'FAIL'} {n} {time.time() - t0:.1f}s {'' if ok else msg}", flush=True)
    print("failed", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
