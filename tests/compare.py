"""Compare every registered query with its SQL on one scale: python tests/compare.py DIR [NAME...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names: list[str], data: list) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda x: round(x, 9) + 0.0 if isinstance(x, float) else float(x) if type(x).__name__ == "Decimal" else x
    return sorted((tuple(fix(r[i]) for i in order) for r in data), key=repr)


def compare(spark, sf_dir: str, names: list[str]) -> list[str]:
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), []
    for name in names or [n for n in queries if n in oracles]:
        began = time.time()
        try:
            df = queries[name](spark, sf_dir)
            got = rows(df.columns, [tuple(r) for r in df.collect()])
            cur = con.execute(oracles[name])
            want = rows([d[0] for d in cur.description], cur.fetchall())
            ok = sorted(df.columns) == sorted(d[0] for d in cur.description) and got == want
            print(f"{name}: {'ok' if ok else 'DIFFERS'} {len(got)} {len(want)} {time.time() - began:.1f} s" + ("" if ok else f"\n  {df.columns} {got[:2]}\n  {[d[0] for d in cur.description]} {want[:2]}"), flush=True)
        except Exception as e:
            ok = False
            print(f"{name}: {str(e)[:260]}", flush=True)
        if not ok:
            bad.append(name)
    return bad


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    print("differ:", compare(s, sys.argv[1], sys.argv[2:]))
