"""Every query runs; those that have SQL give its rows."""

import re

import pandas as pd
import pytest

from notemill.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple("" if pd.api.types.is_scalar(x) and pd.isna(x) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, data, duck):
    mine, theirs = QUERIES[name](spark, data).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, data):
    assert QUERIES[name](spark, data).count() > 0


@pytest.mark.parametrize("name", ["article_text", "drop_selector", "strip_noise_text", "article_title"])
def test_references_without_semicolon(name, spark, duck, tmp_path):
    """A title cut off inside a reference, as larger tables have it."""
    page = "<html><head><title>{0}</title></head><body><nav>x&gt;</nav><article><h1>{0}</h1><p>b &quot;{0}&quot;</p><p>c &lt; d&quot</p></article><footer>&copy; y</footer></body></html>"
    frame = pd.DataFrame({"page_id": range(6), "url": "http://a.org/", "html": [page.format(t) for t in ("a&amp;&amp", "a&amp;&am", "a&amp;&", "&lt", "a&gt;&quot", "a")]})
    frame.to_parquet(tmp_path / "pages.parquet")
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.execute(SQL[name].replace("FROM pages", "FROM temp.pages")).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["chunk_documents", "chunk_roundtrip"])
def test_no_book_is_one_row(name, spark, data):
    """A book's documents are grouped by their place and their chunk, never by source alone."""
    plan = QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    groups = re.findall(r"Aggregate \[(.*?)\], \[", plan)
    assert groups and all("source" not in g.split("#")[0] for g in groups)
    assert len(groups) >= 2
