"""Run registered queries and their SQL side by side on the provided tables.

Usage: python tests/oracle_check.py [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}".replace("-0.000000", "0.000000")
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(normal(v) for v in value) + "]"
    return str(value)


def kind(value) -> str:
    return type(value).__name__


def compare(columns_a, rows_a, columns_b, rows_b) -> str:
    if sorted(columns_a) != sorted(columns_b):
        return f"columns differ: {sorted(columns_a)} / {sorted(columns_b)}"
    order_a = [columns_a.index(c) for c in sorted(columns_a)]
    order_b = [columns_b.index(c) for c in sorted(columns_a)]
    for i, j in zip(order_a, order_b):
        kinds = {kind(r[i]) for r in rows_a} | {kind(r[j]) for r in rows_b}
        if len(kinds - {"NoneType"}) > 1:
            return f"type of {columns_a[i]} differs: {kinds}"
    a = Counter(tuple(normal(r[i]) for i in order_a) for r in rows_a)
    b = Counter(tuple(normal(r[j]) for j in order_b) for r in rows_b)
    if a != b:
        more, less = list((a - b).items()), list((b - a).items())
        return (
            f"rows differ ({len(rows_a)} / {len(rows_b)}, {len(more)} only here): "
            f"{sorted(columns_a)}\n    here {str(sorted(more)[:2])[:700]}\n    sql  {str(sorted(less)[:2])[:700]}"
        )
    return ""


def main() -> int:
    import duckdb
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    oracles = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            begin = time.time()
            df = build(spark, folder)
            rows = df.collect()
            here = time.time() - begin
            if name not in oracles:
                print(f"rows {name}: {len(rows)} rows, {here:.2f}s {df.columns}", flush=True)
                continue
            begin = time.time()
            result = db.execute(oracles[name])
            columns = [d[0] for d in result.description]
            expected = result.fetchall()
            there = time.time() - begin
            fault = compare(df.columns, [tuple(r) for r in rows], columns, expected)
        except Exception as error:
            fault, rows, here, there = f"{type(error).__name__}: {str(error)[:1500]}", [], 0, 0
        bad += bool(fault)
        print(f"{'BAD ' if fault else 'ok  '} {name}: {len(rows)} rows, {here:.2f}s / {there:.2f}s {fault}", flush=True)
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
