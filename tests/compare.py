"""Run a query and its reference SQL and compare the rows as typed multisets."""

from __future__ import annotations

import collections
import pathlib
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if pathlib.Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def difference(plan, sql: str, spark, con, folder: str) -> str | None:
    df = plan(spark, folder)
    cols = sorted(df.columns)
    mine = collections.Counter(tuple(x) for x in df.select(*[f"`{c}`" for c in cols]).collect())
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    order = [names.index(c) for c in cols]
    theirs = collections.Counter(tuple(row[i] for i in order) for row in rel.fetchall())
    typed = lambda counter: {tuple(type(v) for v in row if v is not None) for row in counter}
    if mine == theirs:
        kinds = [{type(v) for row in side for v in row if v is not None} for side in (mine, theirs)]
        return None if kinds[0] == kinds[1] else f"types {kinds}"
    extra, lack = mine - theirs, theirs - mine
    return (
        f"rows {sum(mine.values())} vs {sum(theirs.values())}, {sum(extra.values())} differ\n"
        f"  cols  {cols}\n  spark {[str(x)[:600] for x in list(extra)[:2]]}\n"
        f"  sql   {[str(x)[:600] for x in list(lack)[:2]]}"
    )


if __name__ == "__main__":
    sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
    from creditloom.plans import PLANS, SQL
    from creditloom.session import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:] or list(PLANS)
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for name in wanted:
        if name.endswith("*"):
            wanted += [n for n in PLANS if n.startswith(name[:-1])]
            continue
        t = time.time()
        try:
            if name in SQL:
                diff = difference(PLANS[name], SQL[name], spark, con, folder)
            else:
                rows = PLANS[name](spark, folder).collect()
                diff = None if rows else "no rows"
        except Exception as e:  # report and go on
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += diff is not None
        mark = "ok  " if diff is None else "FAIL"
        print(f"{mark} {name:26s} {time.time() - t:6.1f}s {'' if name in SQL else '(rows only)'} {diff or ''}", flush=True)
    print(f"{len(wanted)} run, {bad} failed")
