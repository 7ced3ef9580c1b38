"""Runs a driver query and its SQL side by side on the smallest data."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages chunks facts evidence fact_embeddings entities predicate_registry eval_items".split()


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return str(v)[:19] if hasattr(v, "isoformat") else v


def same(spark, sf, query, sql):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = c.execute(sql)
    cols = [x[0] for x in want.description]
    df = query(spark, sf)
    assert sorted(df.columns) == sorted(cols)
    a = sorted((tuple(map(norm, r)) for r in want.fetchall()), key=str)
    b = sorted((tuple(map(norm, r)) for r in df.select(*cols).collect()), key=str)
    assert a == b
