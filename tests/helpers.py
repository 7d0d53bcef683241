"""Shared by the tests."""


def rows(df, *cols):
    """Rows as sorted tuples, nulls and all."""
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=repr)
