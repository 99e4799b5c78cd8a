"""Runs registered queries next to their SQL and compares rows: python -m tests.oracle_check DIR [names...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        value = float(value)
        return None if math.isnan(value) else round(value, 6) + 0.0
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        ([tuple(plain(r[i]) for i in order) for r in rows]), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    )


def compare(spark, con, name, query, oracle, sf_dir):
    start = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if oracle is None:
        return took, len(got), None, ""
    start = time.time()
    cur = con.execute(oracle)
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    sql_took = time.time() - start
    if sorted(names) != sorted(df.columns):
        return took, len(got), False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if got == want:
        return took, len(got), True, f"sql {sql_took:.1f}s"
    extra = [r for r in got if r not in set(want)][:3]
    missing = [r for r in want if r not in set(got)][:3]
    return took, len(got), False, f"{len(got)} vs {len(want)} rows; only spark {extra}; only sql {missing}"


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from cardmill.session import build_session

    sf_dir, names = argv[0], argv[1:]
    spark = build_session("oracle-check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    todo, sql = queries(), oracle_sql()
    bad = []
    for name in names or todo:
        try:
            took, n, same, note = compare(spark, con, name, todo[name], sql.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            took, n, same, note = 0, 0, False, f"{type(e).__name__}: {str(e)[:1500]}"
        if same is False:
            bad.append(name)
        print(f"{'OK ' if same else '-- ' if same is None else 'BAD'} {name:28s} {took:6.1f}s {n:7d} rows {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
