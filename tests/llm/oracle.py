"""Spark results against DuckDB's, as multisets of rows."""

import duckdb


def cell(x):
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(cell(r[c]) for c in names) for r in df.collect())


def rows_sql(sql, **tables):
    with duckdb.connect() as con:
        for name, table in tables.items():
            if isinstance(table, str):
                con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{table}'")
            else:
                con.register(name, table)
        out = con.execute(sql)
        names = [d[0] for d in out.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in out.fetchall())


def agree(df, sql, **tables):
    got, want = rows_of(df), rows_sql(sql, **tables)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    wrong = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not wrong, wrong[:3]
