"""Compare registered queries with their SQL: ``python -m registry.check [names...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

import registry
from geocurate.runtime import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return str(value)


def rows_of(names: list[str], rows) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def type_difference(df, description) -> str:
    """Columns whose type differs between Spark and SQL."""
    want = {d[0]: str(d[1]) for d in description}
    got = {f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    return ", ".join(f"{c}: {t} != {want[c]}" for c, t in got.items() if c in want and want[c] != t)


def compare(spark, con, sf: str, name: str) -> str:
    """Empty text if both sides agree, else the first difference."""
    got_df = registry.QUERIES[name](spark, sf)
    got = rows_of(got_df.columns, [tuple(r) for r in got_df.collect()])
    if name not in registry.ORACLES:
        return "" if got[1] else "no rows"
    result = con.execute(registry.ORACLES[name])
    want = rows_of([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])}"
    for a, b in zip(*(side[1] for side in (got, want))):
        if a != b:
            return f"{a} != {b}"
    types = type_difference(got_df, result.description)
    if types:
        return f"types differ, {types}"
    return "" if got[1] else "no rows on either side"


def main(argv: list[str]) -> int:
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    registry.load_all()
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = 0
    for name in argv or list(registry.QUERIES):
        start = time.time()
        try:
            problem = compare(spark, con, sf, name)
        except Exception as error:  # report and go on with the other queries
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        mark = "FAIL" if problem else ("ok" if name in registry.ORACLES else "ok (rows only)")
        print(f"{mark:15s} {time.time() - start:6.2f}s {name} {problem}", flush=True)
    print(f"{failed} failed of {len(argv or registry.QUERIES)}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
