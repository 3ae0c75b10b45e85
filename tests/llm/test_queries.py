"""The corpus queries beside their SQL, over whole small tables."""

from __future__ import annotations

import os

import pytest

from sparkdoc.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    answer = duck.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(answer.columns) == columns
    at = [answer.columns.index(c) for c in columns]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert got == sorted((tuple(r[i] for i in at) for r in answer.fetchall()), key=str)


def test_whole_articles(spark):
    """Every page of the tables has one article element: its text, by another route."""
    import html
    import re

    def article(page: str) -> str:
        inner = re.search(r"<article>(.*)</article>", page, re.S).group(1)
        return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))).split())

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in queries.op9_html(spark, DATA).collect():
        assert r.text == article(pages[r.page_id]) and r.n_chars == len(r.text)
