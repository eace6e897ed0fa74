"""Run queries against DuckDB: python tests/check.py [sf] [name ...]"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def oracle_rows(connection, sql):
    cursor = connection.execute(sql)
    return [column[0] for column in cursor.description], cursor.fetchall()


def compare(frame, connection, sql):
    """None where both agree, else what differs."""
    names, expected = oracle_rows(connection, sql)
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    order = sorted(names)
    rows = [tuple(r) for r in frame.select(*[f"`{c}`" for c in order]).collect()]
    at = [names.index(c) for c in order]
    expected = [tuple(r[i] for i in at) for r in expected]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    rows.sort(key=key)
    expected.sort(key=key)
    if rows != expected:
        only = [r for r in rows if r not in expected[:2000]][:3] if len(rows) < 2000 else rows[:2]
        return f"{len(rows)} rows against {len(expected)}; {only} ... {expected[:3]}"
    types = [tuple(type(v) for v in row) for row in (rows[:1] + expected[:1])]
    if not rows:
        return "no rows on either side"
    return None if types[0] == types[1] else f"types {types}"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from pagestream.session import build_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions=8,
                          spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    connection, bad = duck(sf_dir), 0
    for name, query in queries().items():
        if name not in oracle_sql() or sys.argv[2:] and name not in sys.argv[2:]:
            continue
        began = time.time()
        try:
            outcome = compare(query(spark, sf_dir), connection, oracle_sql()[name])
        except Exception as error:  # noqa: BLE001
            outcome = f"{type(error).__name__}: {str(error)[:900]}"
        bad += outcome is not None
        print(f"{name}: {outcome or 'equal'} ({time.time() - began:.1f} s)", flush=True)
    print("different:", bad)
    sys.exit(bool(bad))
