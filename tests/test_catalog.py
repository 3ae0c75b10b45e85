"""Every query beside its DuckDB SQL, and the guard around the corpus operators."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from sparkdoc.plans import catalog

REPO = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    answer = duck.sql(catalog.SQL[name])
    assert sorted(answer.columns) == columns
    at = [answer.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in answer.fetchall()), key=str)


@needs_data
@pytest.mark.parametrize("name", ["doc_embedding_text", "doc_upsert_frame", "doc_list_page", "doc_delete", "doc_embed_frame"])
def test_empty_and_absent_texts_match_sql(spark, duck, name, tmp_path):
    """An empty text has a length and a line of its own; one that is null has neither."""
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{DATA}/{t}.parquet", tmp_path / f"{t}.parquet")
    odd = f"select doc_id, case doc_id % 5 when 0 then '' when 1 then null else text end as text, lang, source, n_chars from '{DATA}/documents.parquet'"
    duck.sql(f"copy ({odd}) to '{tmp_path}/documents.parquet' (format parquet)")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    query = f"with documents as (from '{tmp_path}/documents.parquet'), " + catalog.SQL[name].removeprefix("with ") if catalog.SQL[name].startswith("with ") else f"with documents as (from '{tmp_path}/documents.parquet') {catalog.SQL[name]}"
    answer = duck.sql(query)
    at = [answer.columns.index(c) for c in columns]
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in answer.fetchall()), key=str)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_entry_without_the_corpus_operators(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'kv_scan' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env={**os.environ, "PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"}, check=True)


def test_broken_corpus_operators_are_not_hidden(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    package = tmp_path / "r/sparkdoc/llm"
    package.mkdir()
    (package / "__init__.py").write_text("")
    (package / "queries.py").write_text("import no_such_module")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path / "r", env={**os.environ, "PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"}, capture_output=True, text=True)
    assert run.returncode and "no_such_module" in run.stderr


@needs_data
def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 100
