"""Run every query on Spark and its SQL on DuckDB and compare the results.

python -m checks.run [sf_dir] [query ...]
"""

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES
from pricetrail.session import session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def cell(value: object) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return repr(value)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def main(sf_dir: str, names: list[str]) -> int:
    spark = session(
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    failed = []
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            got = rows_of(df.columns, df.collect())
        except Exception as error:  # noqa: BLE001 - report and go on
            print(f"FAIL {name}: {str(error)[:1500]}")
            failed.append(name)
            continue
        took = time.time() - start
        if name not in ORACLE:
            print(f"---- {name}: {len(got)} rows, {took:.1f}s, no SQL")
            continue
        start = time.time()
        try:
            result = db.execute(ORACLE[name])
            columns = [d[0] for d in result.description]
            want = rows_of(columns, result.fetchall())
        except Exception as error:  # noqa: BLE001 - report and go on
            print(f"FAIL {name}: SQL {str(error)[:1500]}")
            failed.append(name)
            continue
        if sorted(columns) != sorted(df.columns) or got != want:
            failed.append(name)
            print(f"DIFF {name}: {len(got)} rows, SQL {len(want)}; {sorted(df.columns)} "
                  f"{sorted(columns)}")  # fmt: skip
            only_got, only_want = sorted(set(got) - set(want)), sorted(set(want) - set(got))
            print("   spark only", len(only_got), only_got[:3])
            print("   sql only  ", len(only_want), only_want[:3])
        else:
            print(f"ok   {name}: {len(got)} rows, {took:.1f}s, SQL {time.time() - start:.1f}s")
    print(f"{len(failed)} failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    arguments = sys.argv[1:] or ["/root/testdata/sf0.01"]
    sys.exit(bool(main(arguments[0], arguments[1:])))
