"""Run a query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract  # noqa: E402
from bindery.session import local_session  # noqa: E402

DATA = "/root/testdata"


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(f"{DATA}/sf{sf}").glob("*.parquet")):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def differences(spark, con, name: str, sf: str) -> list[str]:
    """Empty when columns and rows agree."""
    frame = contract.queries()[name](spark, f"{DATA}/sf{sf}")
    columns = sorted(frame.columns)
    got = Counter(tuple(r) for r in frame.select(*columns).collect())
    sql = contract.oracle_sql()[name]
    relation = con.sql(sql)
    if sorted(relation.columns) != columns:
        return [f"columns {columns} against {sorted(relation.columns)}"]
    order = [relation.columns.index(c) for c in columns]
    want = Counter(tuple(row[i] for i in order) for row in relation.fetchall())
    types = dict(zip(relation.columns, map(str, relation.types)))
    out = [f"type {c} {t}" for c, t in types.items() if t == "HUGEINT" or t.startswith("DECIMAL")]
    if got != want:
        out.append(f"rows {sum(got.values())} against {sum(want.values())}")
        out += [f"only Spark  {str(r)[:600]}" for r in list((got - want))[:2]]
        out += [f"only DuckDB {str(r)[:600]}" for r in list((want - got))[:2]]
    return out


if __name__ == "__main__":
    scale, names = sys.argv[1], sys.argv[2:]
    session = local_session(8)
    session.sparkContext.setLogLevel("OFF")
    con = connect(scale)
    for query in names or contract.queries():
        start = time.time()
        try:
            problems = differences(session, con, query, scale)
        except Exception as problem:  # a failed query is a finding, not a stop
            problems = [repr(problem)[:900]]
        print("ok  " if not problems else "DIFF", query, round(time.time() - start, 1), flush=True)
        for line in problems:
            print("     ", line, flush=True)
