"""Each query of the library against the same in SQL, or at least that it gives rows."""

import pytest

from tessella.plans import catalogue
from tests.conftest import plain


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    if name not in catalogue.SQL:
        assert got
        return
    names, rows = duck(catalogue.SQL[name])
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(got) == plain(tuple(r[i] for i in order) for r in rows)


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["win_no", "ratio", "line"]
    assert df.count() > 0
