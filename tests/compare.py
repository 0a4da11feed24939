"""Compare registered queries with their SQL in DuckDB: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plain(value, digits: int = 6):
    """A value both engines agree on: floats rounded, time zones dropped, lists as tuples."""
    import datetime
    import decimal
    import math

    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else round(float(value), digits) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def oracle(sf_dir: str):
    """A DuckDB connection with the tables of ``sf_dir`` as views."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def compare(df, con, sql: str) -> str:
    """Empty if the rows of ``df`` and ``sql`` are the same, else what differs."""
    relation = con.sql(sql)
    columns = sorted(df.columns)
    if columns != sorted(relation.columns):
        return f"columns {columns} and {sorted(relation.columns)}"
    key = lambda row: tuple((v is None, str(v)) for v in row)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    at = [relation.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=key)
    if ours == theirs:
        return ""
    only = [r for r in ours if r not in set(theirs)][:3], [r for r in theirs if r not in set(ours)][:3]
    return f"{len(ours)} and {len(theirs)} rows; only here {only[0]}, only there {only[1]}"


if __name__ == "__main__":
    import __spark_entry__ as entry

    from foliodex.session import local_session

    spark, con = local_session(), oracle(sys.argv[1])
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        began = time.time()
        if name in sql:
            said = compare(queries[name](spark, sys.argv[1]), con, sql[name]) or "same"
        else:
            said = f"{queries[name](spark, sys.argv[1]).count()} rows, no SQL"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
