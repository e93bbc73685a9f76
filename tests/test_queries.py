"""Every registered query that has an oracle against DuckDB, on the small tables."""

import os

import duckdb
import pytest

from quarry.plans import registry
from quarry.plans.registry import SQL, Q

registry.load()

SF = os.environ.get("QUARRY_TEST_SF", "/root/testdata/sf0.001")


def rows(df):
    df = df.astype(object).where(df.notna(), None)[sorted(df.columns)] if len(df) else df
    number = lambda x: round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted((tuple(number(x) for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(Q))
def test_query(name, spark, duck):
    got = Q[name](spark, SF)
    mine = got.toPandas()
    if name in SQL:
        theirs = duck.sql(SQL[name]).df()
        assert sorted(mine.columns) == sorted(theirs.columns)
        assert rows(mine) == rows(theirs)
    else:
        assert len(mine) > 0


def test_a_text_keeps_quotes_that_are_its_own(spark, tmp_path):
    texts = ['said at the end: token = "9f14a7029c8514df"', '"So it begins," said nobody to no one in there', '  ' + "x" * 28 + '""  ', '"' + "y" * 799 + '"', "short", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(Q["hypothetical_documents"](spark, str(tmp_path)).toPandas()) == rows(con.sql(SQL["hypothetical_documents"]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_imports_the_llm_subpackage():
    import pathlib

    for p in pathlib.Path(__file__).parent.parent.joinpath("quarry").rglob("*.py"):
        if "llm" not in p.parts:
            assert "quarry.llm" not in p.read_text(), p
