import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TESSELLA_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tessella import session

    s = session("local[4]", 4, driver_memory="4g", **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tessella-tests-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    """DuckDB with the tables as views; returns (column names, rows) of a statement."""
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")

    def run(sql):
        out = con.sql(sql)
        return out.columns, out.fetchall()

    return run


def plain(rows):
    """Rows in a fixed order, with floats to nine places."""
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
