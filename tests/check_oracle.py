"""Run every registered query next to its SQL twin and compare the rows.

    python tests/check_oracle.py [folder] [name prefix …]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder: str):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if hasattr(value, "as_tuple"):
        return round(float(value), 5) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(normal(row[i]) for i in order) for row in rows), key=lambda row: tuple(map(repr, row)))


def compare(spark, con, folder: str, name: str, run, text: str | None) -> str:
    """Empty text when equal, else what differs."""
    df = run(spark, folder)
    mine = rows_of(df.columns, [tuple(row) for row in df.collect()])
    if text is None:
        return "" if mine[1] else "no rows"
    cursor = con.execute(text)
    theirs = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} / {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} / {len(theirs[1])}"
    if not mine[1]:
        return "both empty"
    wrong = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b or tuple(map(type, a)) != tuple(map(type, b))]
    return f"{len(wrong)} of {len(mine[1])} rows differ: {wrong[0]}" if wrong else ""


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from lagwatch.session import build_session
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("check", "local[8]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, failed = duck(folder), oracle_sql(), 0
    print("twins without query:", sorted(set(oracle) - set(queries())))
    for name, run in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, folder, name, run, oracle.get(name))
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s "
              f"{'' if name in oracle else '(rows only) '}{problem}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
