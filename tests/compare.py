"""Compare queries with their SQL twins: python -m tests.compare SF_DIR [NAME...]."""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        if Path(f"{sf_dir}/{table}.parquet").exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return None if isinstance(value, float) and math.isnan(value) else round(float(value), 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def rows_of(names: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(row[i]) for i in order) for row in rows)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if df and the SQL's result hold the same rows under the same names."""
    names, got = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    wanted_names, wanted = rows_of([x[0] for x in result.description], result.fetchall())
    if names != wanted_names:
        return f"columns {names} and {wanted_names}"
    if got != wanted:
        return f"{sum(got.values())} rows and {sum(wanted.values())}; only Spark {list((got - wanted).items())[:2]}; only SQL {list((wanted - got).items())[:2]}"
    return ""


def main() -> None:
    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con, queries, oracles = session(), database(sf_dir), entry.queries(), entry.oracle_sql()
    chosen = [q for q in queries if not names or any(q == n or (n.endswith("*") and q.startswith(n[:-1])) for n in names)]
    bad = 0
    for name in chosen:
        began = time.time()
        try:
            df = queries[name](spark, sf_dir)
            said = difference(df, con, oracles[name]) if name in oracles else f"no SQL; {df.count()} rows"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(said) and not said.startswith("no SQL")
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
    print(f"{len(chosen)} queries, {bad} differ")


if __name__ == "__main__":
    main()
