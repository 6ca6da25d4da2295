"""Run registered queries and their SQL side by side: ``python tests/compare.py [sf_dir] [name-prefix ...]``."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(v + 0.0)
    return str(v)


def kind(t):
    t = t.upper()
    for name, starts in {
        "int": ("TINYINT", "SMALLINT", "INT", "BIGINT", "LONG"),
        "float": ("DOUBLE", "FLOAT"),
        "bool": ("BOOL",),
        "str": ("STRING", "VARCHAR"),
    }.items():
        if t.startswith(starts):
            return name
    return t


def compare(spark, con, folder, name, fn, sql):
    df = fn(spark, folder)
    cols = sorted(df.columns)
    assert len(set(cols)) == len(cols), f"{name}: duplicate columns {cols}"
    spark_rows = [tuple(r[c] for c in cols) for r in df.collect()]
    if sql is None:
        return f"rows-only {len(spark_rows)}"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    duck_types = {d[0]: kind(str(d[1])) for d in rel.description}
    rows = rel.fetchall()
    assert sorted(names) == cols, f"{name}: columns {sorted(names)} vs {cols}"
    spark_types = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    assert spark_types == duck_types, f"{name}: types { {c: (spark_types[c], duck_types[c]) for c in cols if spark_types[c] != duck_types[c]} }"
    at = [names.index(c) for c in cols]
    a = sorted(tuple(norm(v) for v in r) for r in spark_rows)
    b = sorted(tuple(norm(r[i]) for i in at) for r in rows)
    assert len(a) == len(b), f"{name}: {len(a)} rows vs {len(b)}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
        raise AssertionError(f"{name}: {len(bad)} of {len(a)} differ; cols {cols}; spark {bad[0][0]} duck {bad[0][1]}")
    return f"equal {len(a)}"


def main():
    from pyspark.sql import SparkSession

    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            result = compare(spark, con, folder, name, fn, oracles.get(name))
        except Exception as e:  # report and go on
            failed.append(name)
            result = "FAILED " + str(e).replace("\n", " ")[:700]
        print(f"{name:45s} {time.time() - start:6.2f}s {result}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
