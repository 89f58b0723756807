"""Compare a query's rows with its SQL in DuckDB, regardless of order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and v != v) or type(v).__name__ in ("NAType", "NaTType"):
        return "NULL"
    if hasattr(v, "__iter__") and not isinstance(v, str):
        return str([_cell(x) for x in v])
    try:
        return repr(round(float(v), 6) + 0.0)
    except (TypeError, ValueError):
        return str(v)


def rows_of(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return list(pdf.columns), sorted(tuple(map(_cell, r)) for r in pdf.itertuples(index=False))


def assert_same(pdf, con, sql):
    got, want = rows_of(pdf), rows_of(con.sql(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
