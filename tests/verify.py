"""Run queries() against oracle_sql() as the driver does: python tests/verify.py [SF_DIR] [NAME...]."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def cell(v):
    import datetime
    import decimal
    import math

    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int,)):
        return int(v)
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(float(v)) else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def main():
    import tempfile

    import duckdb
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    args = sys.argv[1:]
    d = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="verify-")).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(d).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if f.is_dir() else ''}')")
    oracle, bad = e.oracle_sql(), 0
    for name, q in e.queries().items():
        if args and name not in args:
            continue
        t = time.time()
        try:
            df = q(spark, d)
            got = df.collect()
            took = time.time() - t
            if name not in oracle:
                print(f"rows {name}: {len(got)} in {took:.1f} s", flush=True)
                continue
            rel = con.execute(oracle[name])
            names = [c[0] for c in rel.description]
            want = rel.fetchall()
            if sorted(names) != sorted(df.columns):
                bad += 1
                print(f"BAD {name}: columns {df.columns} {names}", flush=True)
                continue
            a, b = rows_of(got, df.columns), rows_of(want, names)
            if a != b:
                bad += 1
                sa, sb = set(a), set(b)
                print(f"BAD {name}: {len(a)} {len(b)}; only Spark {list(sa - sb)[:3]}; only SQL {list(sb - sa)[:3]}"[:900], flush=True)
            else:
                print(f"ok {name}: {len(a)} rows, {took:.1f} s", flush=True)
        except Exception as x:
            bad += 1
            print(f"BAD {name}: {type(x).__name__} {str(x)[:600]}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
