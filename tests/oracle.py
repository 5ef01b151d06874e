"""Run registered queries beside their SQL twins in DuckDB and compare rows, names and values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return "\0null"
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"n{value:.9g}"
    if isinstance(value, int):
        return f"n{float(value):.9g}" if abs(value) < 1e8 else f"i{value}"
    return f"s{value}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


LAST: dict[str, float] = {}


def compare(spark, con, name, plan, sql, root) -> str:
    from recut.queries.registry import Tables

    began = time.time()
    df = plan(Tables(spark, root))
    got = [tuple(r) for r in df.collect()]
    LAST["spark"] = time.time() - began
    if sql is None:
        return f"rows only: {len(got)}"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"FAIL columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        extra = [r for r in a if r not in set(b)][:2]
        missing = [r for r in b if r not in set(a)][:2]
        return f"FAIL rows {len(a)} != {len(b)} extra={extra} missing={missing}"
    if a != b:
        sb, sa = set(b), set(a)
        return (
            f"FAIL values extra={[r for r in a if r not in sb][:2]} "
            f"missing={[r for r in b if r not in sa][:2]} columns={sorted(names)} "
            f"differing={sum(r not in sb for r in a)}/{len(a)}"
        )
    kinds = {d: t for d, t in df.dtypes}
    return f"ok {len(a)} {kinds if any(t not in ('bigint','string','boolean','double') for t in kinds.values()) else ''}"


def main() -> None:
    root = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = [a for a in sys.argv[2:] if not a.startswith("from=")]
    first = next((a[5:] for a in sys.argv[2:] if a.startswith("from=")), None)
    sys.path.insert(0, ".")
    from recut.queries import load
    from recut.session import local_session

    registry = load()
    spark = local_session(8)
    con = connect(root)
    bad = 0
    for name, plan in registry.plans.items():
        if first and name != first:
            continue
        first = None
        if wanted and not any(w in name for w in wanted):
            continue
        began = time.time()
        try:
            outcome = compare(spark, con, name, plan, registry.sql.get(name), root)
        except Exception as exc:  # report and go on
            outcome = "FAIL " + type(exc).__name__ + " " + str(exc)[:700]
        bad += outcome.startswith("FAIL")
        print(f"{name}: {outcome} [{LAST.get('spark', 0):.1f}s of {time.time() - began:.1f}s]", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
