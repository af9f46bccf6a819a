"""DuckDB over the same tables, compared as the driver does."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    return names, rel.fetchall()


def same(df, sf_dir, sql):
    names, rows = run_sql(sf_dir, sql)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(r[names.index(c)] for c in order) for r in rows), key=repr)
    assert len(got) == len(want)
    assert got == want
