"""Every registered query against its DuckDB twin on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from difflens import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    said = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(said.columns)
    at = [said.columns.index(c) for c in df.columns]
    assert sorted(repr(plain(tuple(r))) for r in df.collect()) == sorted(repr(plain(tuple(r[i] for i in at))) for r in said.fetchall())


def test_previews_read_the_whole_page(spark, tmp_path):
    rows = [(1, "u", " " * 300 + "late"), (2, "u", "a" + "\n" * 250 + "b" * 60), (3, "u", "short")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.preview for r in catalog.queries()["sc_links_previews"](spark, str(tmp_path)).collect()}
    assert got == {1: "late", 2: "a " + "b" * 40 + "…", 3: "short"}
