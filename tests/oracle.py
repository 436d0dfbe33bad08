"""Run registered queries against DuckDB: ``python tests/oracle.py [names...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, decimal.Decimal):
        return f"{float(value):.6g}"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def oracle(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def compare(spark, connection, name, run, sql, sf_dir):
    df = run(spark, sf_dir)
    got = comparable(df.columns, df.collect())
    if sql is None:
        return None, len(got[1]), got
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    wanted = comparable(columns, result.fetchall())
    return got == wanted, len(got[1]), (got, wanted)


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def main(names, sf_dir):
    import __spark_entry__ as entry

    queries, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(queries), set(sqls) - set(queries)
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle(sf_dir)
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            ok, rows, detail = compare(spark, connection, name, queries[name], sqls.get(name), sf_dir)
        except Exception as e:  # report and go on to the next query
            ok, rows, detail = False, -1, str(e)[:1500]
        status = {True: "ok  ", False: "FAIL", None: "rows"}[ok]
        print(f"{status} {name:26} {rows:7} {time.time() - start:6.2f}s", flush=True)
        if ok is False:
            bad += 1
            if isinstance(detail, str):
                print("   ", detail)
            else:
                (gc, gr), (wc, wr) = detail
                print("    columns", gc, wc, "rows", len(gr), len(wr))
                print("    only spark ", [r for r in gr if r not in set(wr)][:3])
                print("    only oracle", [r for r in wr if r not in set(gr)][:3])
        elif ok is None and "-v" in sys.argv:
            for r in detail[1][:12]:
                print("    ", r)
    print("failures", bad)


if __name__ == "__main__":
    main(
        [a for a in sys.argv[1:] if not a.startswith("-")],
        os.environ.get("SF_DIR", "/root/testdata/sf0.01"),
    )
