import re

import pytest

import __spark_entry__ as entry
from versemill.operators import agent as ag

WS = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def test_clean_output_of_every_title(spark, tmp_path):
    titles = ["Đêm xuân", "đầu năm", "ồ lạ", " Ăn tết ", "... «mưa»", "　(quê)", "nghẹn lời", "Thơ", "7 câu", "", " ", None, "—"]
    spark.createDataFrame(list(enumerate(titles)), "rec_no long, title string").write.parquet(f"{tmp_path}/quality_fsoft_v1.parquet")

    def clean(raw):
        text = re.sub(f"^{WS}+|{WS}+$", "", raw)
        text = re.sub(f"^{WS}+|{WS}+$", "", text.rpartition("</think>")[2])
        text = re.sub(f"^(nghèn|nghẹn|nghẽn|[^\\w\\s]+){WS}*", "", text, flags=re.I)
        return text[:1].upper() + text[1:]

    want = {k: (None, None) if t is None else (clean("x</think> nghẹn " + re.sub(f"^{WS}+|{WS}+$", "", t)), clean("x</think> " + t)) for k, t in enumerate(titles)}
    got = {r.rec_no: (r.answer, r.bare) for r in entry.queries()["clean_output"](spark, str(tmp_path)).collect()}
    assert got == want
    assert got[1][0] == "Đầu năm" and got[5][1] == "Quê)"


def test_retrieval_for_every_fiftieth_row(spark):
    duckdb = pytest.importorskip("duckdb")
    name, sf = "tet4_source_material_corpus_v1", "/root/testdata/sf0.01"
    try:
        rows = spark.read.parquet(f"{sf}/{name}.parquet")
    except Exception:
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["topk_retrieval_all"]).fetchall())
    got = sorted(map(tuple, entry.queries()["topk_retrieval_all"](spark, sf).collect()))
    assert got == want and len(got) == 3 * rows.where("rec_no % 50 = 0").count()


def test_retrieval_in_blocks_as_at_once(spark):
    rows = [(k, f"hoa{k % 3} lá{k % 5} mai{k % 7}", [None, "", "x"][k % 3], None) for k in range(40)] + [(40, None, None, None)]
    materials = spark.createDataFrame(rows, "material_id long, text string, author string, url string")
    wishes = spark.createDataFrame([(1, "hoa1 lá2 mai0"), (2, ""), (3, "không đâu"), (4, "lá4 hoa0"), (5, None)], "wish_id long, wish string")
    at_once = {tuple(r) for r in ag.retrieve(wishes.where("wish IS NOT NULL"), materials).collect()}
    in_blocks = {tuple(r) for r in ag.retrieve_many(wishes, materials, wish_block=2, material_block=7).collect()}
    assert {r for r in in_blocks if r[0] != 5} == at_once and sum(r[0] == 5 for r in in_blocks) == 3


def test_audit_summary_as_by_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    name, sf = "tet4_web_staging_v1", "/root/testdata/sf0.01"
    try:
        spark.read.parquet(f"{sf}/{name}.parquet")
    except Exception:
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    found = con.execute(entry.oracle_sql()["audit_summary"])
    names = [d[0] for d in found.description]
    (got,) = entry.queries()["audit_summary"](spark, sf).collect()
    assert got.asDict() == dict(zip(names, found.fetchone())) and 0 < got.rejected < got.accepted and got.sensitive > 0
