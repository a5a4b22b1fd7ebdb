"""Every array query with an oracle gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from tessera.plans import storage_queries  # noqa: F401  (registers its queries)
from tessera.plans.queries import ORACLE_SQL, QUERIES

TABLES = "lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()), key=repr)
    want = sorted(map(tuple, duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})").fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=1e-6)


def test_delete_empty_blocks_takes_the_whole_table(spark, sf_dir, tmp_path):
    """Users and days far beyond those of the smallest tables."""
    c = duckdb.connect()
    shifted = "SELECT * REPLACE (user_id + 1000000 * k AS user_id, ts + to_days(100 * k::INTEGER) AS ts)"
    c.execute(f"COPY ({shifted} FROM '{sf_dir}/events.parquet', (VALUES (0), (1), (3)) t(k)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = sorted(map(tuple, QUERIES["delete_empty_blocks"](spark, str(tmp_path)).select("b0", "b1", "b2").collect()))
    assert got and got == sorted(c.execute(f"SELECT b0, b1, b2 FROM ({ORACLE_SQL['delete_empty_blocks']})").fetchall())
