"""What tests share: the data folder and comparison with SQL."""

DATA = "/root/testdata/sf0.001"


def normal(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 6)
    return value.isoformat() if hasattr(value, "isoformat") else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(normal(r[k]) for k in order) for r in rows), key=lambda r: tuple(("" if v is None else str(v)) for v in r))


def assert_same(df, con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, found.fetchall())
