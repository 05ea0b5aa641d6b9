"""Compare registered queries with their SQL: python tests/check.py [sf] [name-part ...]"""
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

BASE = ("region nation customer supplier part orders lineitem events documents embeddings "
        "pages benchmark labels conversations").split()


def session(cpus="8"):
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("mirrorcheck")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.extraJavaOptions", "-Duser.timezone=UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in BASE:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def compare(sdf, rel):
    scols = sorted(sdf.columns)
    dcols = sorted(rel.columns)
    rows = [tuple(r) for r in sdf.select(*scols).collect()]
    if scols != dcols:
        return False, f"columns {set(scols) ^ set(dcols)}", len(rows)
    drows = rel.project(", ".join(f'"{c}"' for c in dcols)).fetchall()
    if len(rows) != len(drows):
        return False, f"rows {len(rows)} vs {len(drows)}", len(rows)
    a = sorted(tuple(norm(v) for v in r) for r in rows)
    b = sorted(tuple(norm(v) for v in r) for r in drows)
    for x, y in zip(a, b):
        if x != y:
            bad = [(c, p, q) for c, p, q in zip(scols, x, y) if p != q][:4]
            n = sum(1 for p, q in zip(a, b) if p != q)
            return False, f"{n} rows differ, first {x[:3]}: {bad}", len(rows)
    return True, "", len(rows)


if __name__ == "__main__":
    import __spark_entry__ as entry
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), duck(sf_dir)
    oracles = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        t = time.time()
        try:
            if name in oracles:
                ok, why, n = compare(fn(spark, sf_dir), con.sql(oracles[name]))
            else:
                n = len(fn(spark, sf_dir).collect())
                ok, why = n > 0, "rows only"
        except Exception as e:  # noqa: BLE001
            ok, why, n = False, f"{type(e).__name__}: {str(e)[:1500]}", -1
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {n} {time.time() - t:.1f}s {why}", flush=True)
    print("failed:", failed)
