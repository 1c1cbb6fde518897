import duckdb
import pytest

from lexweave.plans.registry import TABLES
from tests.compare import bag


@pytest.fixture(scope="session")
def same_as_sql():
    """Compares a query's rows with its DuckDB twin."""

    def check(spark, name: str, sf_dir: str) -> int:
        import __spark_entry__ as entry

        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        df = entry.queries()[name](spark, sf_dir)
        rows = [tuple(r) for r in df.collect()]
        cur = con.execute(entry.oracle_sql()[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert bag(df.columns, rows) == bag(names, cur.fetchall())
        return len(rows)

    return check
