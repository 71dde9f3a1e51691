"""Each operator's query against the same in SQL."""

import pytest

from tessella.llm import queries
from tests.conftest import plain


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    names, rows = duck(queries.SQL[name])
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(got) == plain(tuple(r[i] for i in order) for r in rows)
