"""Compare every sample query with its SQL: ``python tests/check_oracles.py [sf_dir] [name …]``."""

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, bool):
        return int(value)
    return value


def difference(spark_df, result):
    """Text that tells how the two results differ, or None."""
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    order = sorted(names)
    want = Counter(tuple(plain(dict(zip(names, row))[c]) for c in order) for row in result.fetchall())
    got = Counter(tuple(plain(row[c]) for c in order) for row in spark_df.select(*order).collect())
    if got == want:
        return None
    return f"{order}\n  only Spark: {list((got - want).items())[:3]}\n  only SQL:   {list((want - got).items())[:3]}\n  rows {got.total()} {want.total()}"


def main():
    from __spark_entry__ import oracle_sql, queries
    from veilcraft.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(queries())
    spark, db, failed = build_session(cores=8), database(sf_dir), []
    for name in wanted:
        start = time.time()
        try:
            df = queries()[name](spark, sf_dir)
            problem = difference(df, db.execute(oracle_sql()[name])) if name in oracle_sql() else f"no SQL, {df.count()} rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
        failed += [name] * (problem is not None)
    print(f"{len(wanted) - len(failed)} of {len(wanted)} agree; failed: {failed}")


if __name__ == "__main__":
    main()
