"""Run registered queries on Spark and on DuckDB and compare types and values."""

import math
import sys
import time

import duckdb

from checks.queries import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def open_duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is not None, str(type(v)), v) for v in row)


def _show(v):
    return "NaN" if isinstance(v, float) and math.isnan(v) else v


def compare(spark, con, sf_dir, name):
    """None when equal, else a message. Names without SQL only have to return rows."""
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(_show(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    if name not in ORACLES:
        return None if got else "no rows"
    rel = con.sql(ORACLES[name])
    if sorted(rel.columns) != cols:
        return f"columns {cols} vs {sorted(rel.columns)}"
    types = dict(zip(rel.columns, map(str, rel.types)))
    for f in df.schema.fields:
        if KINDS.get(f.dataType.simpleString()) != types[f.name]:
            return f"type of {f.name}: {f.dataType.simpleString()} vs {types[f.name]}"
    want = con.sql(
        f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({ORACLES[name]})"
    ).fetchall()
    got, want = sorted(got, key=_key), sorted(want, key=_key)
    if got == want:
        return None if got else "equal, but empty"
    diff = [(g, w) for g, w in zip(got, want) if g != w][:3]
    return f"{len(got)} vs {len(want)} rows; columns {cols}; first differences {diff}"


def main(argv):
    from retentia.session import build_local

    sf_dir = argv[0]
    names = [n for n in QUERIES if not argv[1:] or any(n.startswith(p) for p in argv[1:])]
    spark = build_local()
    spark.sparkContext.setLogLevel("ERROR")
    con = open_duck(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            message = compare(spark, con, sf_dir, name)
        except Exception as e:  # report and go on with the next query
            message = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(message)
        kind = "sql " if name in ORACLES else "rows"
        print(f"\n{time.time() - start:6.2f}s {kind} {name}: {message or 'ok'}", flush=True)
    print(f"{len(names)} queries, {bad} differ")


if __name__ == "__main__":
    main(sys.argv[1:])
