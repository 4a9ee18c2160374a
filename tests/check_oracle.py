"""Run every registered query beside its SQL: python tests/check_oracle.py SF_DIR [names...]"""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DUCK_TYPES = {"VARCHAR": "string", "INTEGER": "int", "BIGINT": "bigint", "BOOLEAN": "boolean"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def difference(df, con, sql: str) -> str:
    """'' if the Spark result and the SQL result are equal, else what differs."""
    relation = con.sql(sql)
    theirs = {c: DUCK_TYPES.get(str(t), str(t)) for c, t in zip(relation.columns, relation.types)}
    ours = dict(df.dtypes)
    if ours != theirs:
        return f"schema {ours} != {theirs}"
    columns = sorted(ours)
    left = Counter(tuple(row[c] for c in columns) for row in df.select(*columns).collect())
    order = [relation.columns.index(c) for c in columns]
    right = Counter(tuple(row[i] for i in order) for row in relation.fetchall())
    if left == right:
        return ""
    extra, lacking = list((left - right).items())[:2], list((right - left).items())[:2]
    return f"{sum(left.values())} rows != {sum(right.values())} rows; only Spark {extra}; only SQL {lacking}"


def main() -> None:
    from conftest import build_session

    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = build_session(), connect(sf_dir)
    oracle = entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        problem = difference(query(spark, sf_dir), con, oracle[name])
        print(f"{name:28} {time.time() - start:6.2f}s  {problem[:1500] or 'ok'}", flush=True)


if __name__ == "__main__":
    main()
