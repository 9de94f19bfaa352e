"""Comparisons that several tests use."""


def same_rows(df, expected) -> None:
    """A Spark DataFrame and a pandas one have the same columns and rows, in any order."""
    got = df.toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(expected.columns)
    text = lambda x: x[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert text(got).equals(text(expected))
