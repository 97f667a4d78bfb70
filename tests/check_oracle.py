"""Run registered queries beside their SQL and compare: python tests/check_oracle.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()  # fmt: skip


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def compare(df, con, sql: str) -> str:
    """Empty when equal, else what differs."""
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    theirs = rows_of(names, found.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows vs {len(theirs)}"
    for a, b in zip(ours, theirs, strict=True):
        if a != b:
            return f"{sorted(names)}: {a} vs {b}"
    return ""


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from crossblock.session import session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = session(
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g",
           "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert not set(oracle) - set(queries), set(oracle) - set(queries)
    wrong = 0
    for name in argv[1:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf)
            if name in oracle:
                mid = time.time()
                verdict = compare(df, con, oracle[name]) or "equal"
            else:
                verdict = f"{len(df.collect())} rows, no SQL"
        except Exception as e:
            verdict = "FAILED " + str(e).split("JVM stacktrace")[0][:900]
        bad = verdict.startswith("FAILED") or not (verdict == "equal" or "no SQL" in verdict)
        wrong += bad
        print(f"{'XX' if bad else 'ok'} {name} {time.time() - start:.1f}s {verdict[:1000]}", flush=True)
    print(f"{wrong} wrong")
    return wrong


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
