"""Compare every query with its SQL: ``python tests/oracle_check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def _canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    for name in frame.columns:
        column = frame[name]
        if str(column.dtype) == "Int64":  # whole numbers with nulls, as Spark returns them
            frame = frame.assign(**{name: column.astype("float64")})
        elif str(column.dtype).startswith("datetime"):
            frame = frame.assign(**{name: column.astype("datetime64[us]").astype(str)})
        elif column.dtype == object or str(column.dtype) in ("str", "string"):
            frame = frame.assign(**{name: column.where(column.notna(), "<null>").astype(str)})
    return frame.sort_values(list(frame.columns), ignore_index=True)


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    """What differs between two results, order aside; None if nothing does."""
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} and {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} rows and {len(sql_rows)} rows"
    left, right = _canonical(spark_rows), _canonical(sql_rows)
    for name in left.columns:
        if str(left[name].dtype) != str(right[name].dtype):
            return f"column {name} has type {left[name].dtype} and {right[name].dtype}"
        same = (left[name] == right[name]) | (left[name].isna() & right[name].isna())
        if not same.all():
            i = (~same).to_numpy().argmax()
            return (
                f"column {name}: {(~same).sum()} rows differ, first {left[name][i]!r:.200}"
                f" and {right[name][i]!r:.200}"
            )
    return None


def main() -> int:
    import __spark_entry__ as entry
    from postpulse.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(entry.queries())
    spark = build_session("oracle", "local[8]", {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    connection, failed = connect(sf_dir), 0
    for name in wanted:
        started = time.time()
        try:
            mine = entry.queries()[name](spark, sf_dir).toPandas()
            took = time.time() - started
            sql = entry.oracle_sql().get(name)
            if sql is None:
                verdict = f"rows only: {len(mine)}"
            else:
                verdict = difference(mine, connection.execute(sql).df())
                failed += verdict is not None
                verdict = f"DIFFERENT {verdict}" if verdict else f"ok {len(mine)} rows"
        except Exception as error:  # report and go on with the next query
            failed, took = failed + 1, time.time() - started
            verdict = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        print(f"{name:26s} {took:6.2f}s {time.time() - started - took:6.2f}s {verdict}", flush=True)
    print(f"{failed} failed of {len(wanted)}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
