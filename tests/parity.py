"""python tests/parity.py SF_DIR NAME...: runs queries against their SQL in DuckDB, as the driver does."""

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if isinstance(x, float):
            return f"{x:.6g}"
        if isinstance(x, (list, tuple)):
            return "[" + ",".join(value(y) for y in x) + "]"
        if isinstance(x, dict):
            return "{" + ",".join(value(y) for y in x.values()) + "}"
        return str(x)

    return sorted(tuple(value(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(p)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def compare(spark, con, sf, query, sql):
    t = time.time()
    df = query(spark, sf)
    mine, a = canonical([tuple(r) for r in df.collect()], df.columns)
    took, t = time.time() - t, time.time()
    cur = con.execute(sql)
    theirs, b = canonical(cur.fetchall(), [x[0] for x in cur.description])
    return a == b and mine == theirs, (len(mine), len(theirs), round(took, 1), round(time.time() - t, 1), a if a != b else "", [(x, y) for x, y in zip(mine, theirs) if x != y][:2])


if __name__ == "__main__":
    import __spark_entry__ as e
    from unitquarry.session import local_session

    spark, con = local_session(8), duck(sys.argv[1])
    spark.sparkContext.setLogLevel("ERROR")
    q, o = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or list(q):
        try:
            if name in o:
                ok, how = compare(spark, con, sys.argv[1], q[name], o[name])
                print("OK  " if ok else "DIFF", name, how, flush=True)
            else:
                t = time.time()
                print("rows", name, q[name](spark, sys.argv[1]).count(), round(time.time() - t, 1), flush=True)
        except Exception as x:  # noqa: BLE001
            print("ERR ", name, str(x)[:800], flush=True)
