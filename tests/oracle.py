"""Compares a DataFrame with DuckDB's result of the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def rows(frame, names):
    frame = frame[names]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


def check(df, sql, folder):
    ours, theirs = df.toPandas(), database(folder).execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    names = sorted(ours.columns)
    for c in names:
        # A column of longs with nulls comes as floats from one side.
        if str(theirs[c].dtype).startswith("Int") and ours[c].dtype.kind == "f":
            ours[c] = ours[c].astype(theirs[c].dtype)
    assert rows(ours, names) == rows(theirs, names)
    return ours
