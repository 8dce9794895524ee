"""Rows of a Spark result against rows of SQL run by DuckDB on the same Parquet files."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, float) and math.isnan(x):
        return "nan"
    return x


def ordered(rows):
    """Rows as lists by column name, in an order that small differences of floats don't change."""
    rows = [[plain(r[c]) for c in sorted(r)] for r in rows]
    return sorted(rows, key=lambda r: (repr([x for x in r if not isinstance(x, float)]), [round(x, 4) for x in r if isinstance(x, float)]))


def same(spark_rows, sql_rows):
    a, b = ordered(spark_rows), ordered(sql_rows)
    assert len(a) == len(b)
    if a:
        assert sorted(spark_rows[0]) == sorted(sql_rows[0])
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            if isinstance(p, float) and isinstance(q, float):
                assert p == q or abs(p - q) <= 2e-6 * max(1.0, abs(p)), (x, y)
            else:
                assert p == q and isinstance(p, bool) == isinstance(q, bool), (x, y)


def sql(text, folder):
    with duckdb.connect() as db:
        db.execute("SET TimeZone = 'UTC'")
        for p in Path(folder).glob("*.parquet"):
            db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
        return db.execute(text).to_arrow_table().to_pylist()
