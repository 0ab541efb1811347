"""Compare registered queries with their oracle SQL: python tests/check_oracle.py [sf dir] [name parts...]"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def oracle(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float) and v == 0:
            return 0.0
        return v
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, folder, name, fn, sql):
    """Return None when equal, else what differs."""
    t0 = time.time()
    df = fn(spark, folder)
    got = df.collect()
    t1 = time.time()
    if sql is None:
        return None, len(got), t1 - t0, 0.0
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    t2 = time.time()
    problem = None
    if sorted(cols) != sorted(df.columns):
        problem = f"columns {sorted(df.columns)} vs {sorted(cols)}"
    else:
        kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        off = {c: (d, types[c]) for c, d in df.dtypes if kinds.get(d) != types[c]}
        a, b = normal(got, df.columns), normal(want, cols)
        if a != b:
            bad = [(x, y) for x, y in zip(a, b) if x != y]
            problem = f"rows {len(a)} vs {len(b)}, {len(bad)} differ, first {bad[:2]} columns {sorted(cols)}"
        elif off:
            problem = f"types only: {off}"
    return problem, len(got), t1 - t0, t2 - t1


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, failed, sqls = oracle(folder), [], entry.oracle_sql()
    for name, fn in entry.queries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        try:
            problem, n, a, b = compare(spark, con, folder, name, fn, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            problem, n, a, b = f"{type(e).__name__}: {str(e)[:600]}", -1, 0, 0
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} rows={n} spark={a:.1f}s oracle={b:.1f}s"
              f"{'' if name in sqls else ' (no oracle)'} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
