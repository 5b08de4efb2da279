"""Run registered queries and their SQL counterparts side by side.

``python tests/compare.py <sf_dir> [query ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    if isinstance(v, float) and v.is_integer():
        return int(v)
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(body, key=repr)


def close(a, b) -> bool:
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return abs(a - b) <= 2e-6 * max(1.0, abs(a), abs(b))
    return a == b


def compare(df, relation) -> tuple[str, str]:
    """('same' | 'close' | 'DIFFERENT', detail)."""
    c1, r1 = table(df.columns, [tuple(r) for r in df.collect()])
    c2, r2 = table(list(relation.columns), relation.fetchall())
    if c1 != c2:
        return "DIFFERENT", f"columns {c1} / {c2}"
    if len(r1) != len(r2):
        return "DIFFERENT", f"{len(r1)} / {len(r2)} rows"
    if r1 == r2 and [list(map(repr, r)) for r in r1] == [list(map(repr, r)) for r in r2]:
        return "same", f"{len(r1)} rows"
    bad = [(a, b) for a, b in zip(r1, r2) if not all(close(x, y) for x, y in zip(a, b))]
    if bad:
        return "DIFFERENT", f"{len(bad)} of {len(r1)} rows, {c1}, first {bad[0]}"
    first = next((a, b) for a, b in zip(r1, r2) if repr(a) != repr(b))
    return "close", f"{len(r1)} rows, e.g. {first}"


def main() -> None:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from flowlens.session import get_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    oracle, queries = entry.oracle_sql(), entry.queries()
    spark, con = get_session("local[8]", 8), duck(sf_dir)
    for n in names or queries:
        t = time.time()
        try:
            if n in oracle:
                status, detail = compare(queries[n](spark, sf_dir), con.sql(oracle[n]))
            else:
                status, detail = "rows", str(len(queries[n](spark, sf_dir).collect()))
        except Exception as ex:  # noqa: BLE001 - the run goes on with the next query
            status, detail = "FAILED", str(ex)[:500].replace("\n", " ")
        print(f"{status:10s} {n:24s} {time.time() - t:6.1f}s {detail[:700]}", flush=True)


if __name__ == "__main__":
    main()
