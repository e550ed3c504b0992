"""Run registered queries on Spark and their oracles on DuckDB and compare the rows.

``python -m tablesight.catalog.check [sf] [name ...]``
"""

from __future__ import annotations

import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def normal(frame):
    cols = sorted(frame.columns)
    rows = []
    for row in frame[cols].itertuples(index=False, name=None):
        rows.append(tuple(None if v is None or v != v else v for v in row))
    return cols, sorted(rows, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark, con, fn, sql, folder) -> tuple[bool, str]:
    # toArrow: pandas on either side would turn a nullable bigint into a float
    mine = fn(spark, folder).toArrow().to_pandas(types_mapper=None, integer_object_nulls=True)
    theirs = con.sql(sql).to_arrow_table().to_pandas(integer_object_nulls=True)
    (c1, r1), (c2, r2) = normal(mine), normal(theirs)
    if c1 != c2:
        return False, f"columns {c1} != {c2}"
    kinds1, kinds2 = mine[c1].dtypes.astype(str).to_dict(), theirs[c2].dtypes.astype(str).to_dict()
    if r1 != r2:
        bad = [(a, b) for a, b in zip(r1, r2) if a != b][:3]
        return False, f"rows {len(r1)} vs {len(r2)}; first differences {bad}; types {kinds1} {kinds2}"
    note = "" if kinds1 == kinds2 else f" (types differ: {[(k, kinds1[k], kinds2[k]) for k in kinds1 if kinds1[k] != kinds2[k]]})"
    return True, f"{len(r1)} rows{note}"


def main(argv: list[str]) -> int:
    from tablesight.catalog import load_all
    from tablesight.catalog.registry import ORACLES, QUERIES
    from tablesight.session import local_session

    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    load_all()
    names = [n for n in QUERIES if not argv[1:] or any(n.startswith(p) for p in argv[1:])]
    spark, con, failed = local_session(), duck(folder), 0
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                ok, note = compare(spark, con, QUERIES[name], ORACLES[name], folder)
            else:
                ok, note = True, f"no oracle, {QUERIES[name](spark, folder).count()} rows"
        except Exception as exc:  # report and go on
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.2f}s {note}", flush=True)
    print(f"{len(names) - failed}/{len(names)} ok", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
