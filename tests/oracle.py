"""Compares a query's rows with those of its SQL in DuckDB, order aside."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def same_rows(frame, sql, tables):
    con = duckdb.connect()
    for name, source in tables.items():
        if isinstance(source, str):
            con.execute(f"create view {name} as select * from read_parquet('{source}')")
        else:
            con.register(name, source)
    want, got = con.sql(sql).df(), frame.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    for c in columns:  # integers with nulls come as floats from one, as nullable integers from the other
        if str(want[c].dtype) == "Int64" and got[c].dtype == float:
            want[c] = want[c].astype(float)

    def rows(df):
        df = df[columns].astype(object).where(df[columns].notna(), None)
        return sorted(repr([x if isinstance(x, float) or x is None else str(x) for x in r]) for r in df.itertuples(index=False))

    assert rows(got) == rows(want)


def files(sf=SF):
    return {t: f"{sf}/{t}.parquet" for t in TABLES}
