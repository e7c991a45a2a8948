"""Compare named queries with their SQL: python tests/check_sql.py [sf_dir] [names...]"""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as contract  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False):
        rows.append(tuple(
            None if v is None or v is pd.NA or v != v else
            (round(float(v), 6) + 0.0 if isinstance(v, float) else
             v if isinstance(v, (str, list)) else float(v))
            for v in row))
    return sorted(rows, key=repr)


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    a, b = canonical(spark_df), canonical(sql_df)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{x} != {y}"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(contract.queries())
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), contract.oracle_sql()
    for name in names:
        start = time.time()
        try:
            got = contract.queries()[name](spark, sf_dir).toPandas()
            took = time.time() - start
            if name in sql:
                problem = difference(got, con.sql(sql[name]).df())
                print(f"{'FAIL ' + problem[:300] if problem else 'ok'} {name} {took:.1f}s rows={len(got)}", flush=True)
            else:
                print(f"rows-only {name} {took:.1f}s rows={len(got)}", flush=True)
        except Exception as error:
            print(f"ERROR {name}: {str(error)[:600]}", flush=True)


if __name__ == "__main__":
    main()
