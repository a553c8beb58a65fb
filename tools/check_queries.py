"""Run registered queries beside their SQL and compare columns, rows and values.

python tools/check_queries.py [sf dir] [name prefix ...]
"""

import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from motorpool.bindings import ORACLES, QUERIES  # noqa: E402
from motorpool.schemas import SOURCE_TABLES  # noqa: E402
from motorpool.session import local_session  # noqa: E402


def cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if v != v else f"f{v!r}"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, int):
        return f"i{v}"
    return f"{type(v).__name__}:{v}"


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main():
    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in SOURCE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{directory}/{t}.parquet')")
    bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        started = time.time()
        try:
            df = fn(spark, directory)
            mine = canonical(df.columns, df.collect())
        except Exception as e:  # report and go on to the next query
            bad += 1
            print(f"ERROR {name}: {str(e)[:1500]}")
            continue
        took = time.time() - started
        if name not in ORACLES:
            print(f"rows  {name}: {len(mine[1])} rows {took:.2f}s")
            continue
        try:
            cur = con.execute(ORACLES[name])
            theirs = canonical([d[0] for d in cur.description], cur.fetchall())
        except Exception as e:
            bad += 1
            print(f"SQL   {name}: {str(e)[:800]}")
            continue
        if mine == theirs:
            flag = "ok   " if mine[1] else "EMPTY"
            print(f"{flag} {name}: {len(mine[1])} rows {took:.2f}s")
        else:
            bad += 1
            only_mine = [r for r in mine[1] if r not in set(theirs[1])][:3]
            only_theirs = [r for r in theirs[1] if r not in set(mine[1])][:3]
            print(f"DIFF  {name}: {len(mine[1])} vs {len(theirs[1])}\n  {mine[0]} {theirs[0]}\n  spark {only_mine}\n  sql   {only_theirs}")
    print("bad:", bad)


main()
