import importlib.util
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from versemill import catalog

SF = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["rhyme", "n", "words"]


def test_core_stands_without_the_subpackage_for_training_data(monkeypatch):
    root = Path(entry.__file__).parent / "versemill"
    for file in root.rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            assert "versemill.llm" not in file.read_text(encoding="utf-8"), file
    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("versemill.llm") else found(name, *a))
    assert set(entry.queries()) == set(catalog.queries()) and set(entry.oracle_sql()) == set(catalog.oracle_sql())
    assert not any(re.match(r"p\d_", n) for n in entry.queries())


@pytest.mark.parametrize("name", ["rhyme_groups", "couplet_rhyme_pairs", "poem_evaluate", "window_select", "collocation_score", "merge_materials"])
def test_query_as_by_sql(spark, name):
    try:
        tables = {t: spark.read.parquet(f"{SF}/{t}.parquet") and f"{SF}/{t}.parquet" for t in ("documents", "quality_fsoft_v1", "tet4_web_staging_v1", "tet4_source_material_corpus_v1")}
    except Exception:
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t, path in tables.items():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted(map(str, found.fetchall()))
    got = entry.queries()[name](spark, SF).select(*names).collect()
    assert sorted(str(tuple(r)) for r in got) == want
