import datetime as dt
import random

from tests.llm import brute
from versemill.llm import lookalikes as la
from versemill.llm import split_groups as sg
from versemill.llm import survivors as sv
from versemill.llm.textform import reader_form
from versemill.operators.components import connected_components

MATERIAL = "rec_no long, source_id string, unit_type string, text string, author string, url string, source_refs array<struct<source_id:string,url:string,unit_type:string>>, category string, ingested_at timestamp"


def test_reader_form_settles_what_is_not_seen():
    same = ["Trời xanh", "Trời xanh".encode().decode(), "Tr" + "ơ" + "̀" + "i xanh", "Trо̛̀i xanh", "Ｔrời　xanh", "Tr​ời xan­h", "Τrời xаnh", "Trời xanh \r\n"]
    assert {reader_form(t) for t in same} == {"Trời xanh"}
    assert reader_form("Trời, xanh") != reader_form("Trời. xanh") != reader_form("trời. xanh")
    assert reader_form("привет мир") == "привет мир"
    assert reader_form(None) is None and reader_form("") == "" and reader_form(" \n") == ""


def test_repair_needs_script_and_vocabulary(spark):
    rows = [(1, "sông xanh"), (2, "sо̂ng xanh"), (3, "мир и sông"), (4, "sông qzх"), (5, None), (6, "  "), (2, "sо̂ng xanh"), (7, "привет мама")]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "rec_no long, text string, form int")
    got = {r.rec: r.form for r in la.unified(df).collect()}
    assert got[2] == "sông xanh" and got[3] == "мир и sông" and got[7] == "привет мама"
    assert got[4] == "sông qzх"  # the word that would come out is nowhere in the corpus
    assert got[5] is None and got[6] == ""
    assert {(r.rec_a, r.rec_b) for r in la.lookalike_pairs(df).collect()} == {(1, 2)}
    assert la.lookalike_pairs(df.limit(0)).collect() == []


def test_look_alike_pairs_as_by_brute_force(spark):
    r = random.Random(2)
    base = ["Sông dài con cá lội đâu", "Trời cao mây trắng bay mau", "Nắng vàng, hoa nở!"]
    change = [lambda t: t, lambda t: t.replace("o", "о"), lambda t: t.replace("a", "а"), lambda t: t.replace(" ", " "), lambda t: t.replace("c", "c​"), lambda t: t.replace(",", "，"), lambda t: t.replace("S", "Ѕ")]
    rows = [(k, r.choice(change)(r.choice(change)(r.choice(base)))) for k in range(1, 90)] + [(200 + k, base[0]) for k in range(40)]
    df = spark.createDataFrame(rows, "rec_no long, text string")
    assert {(x.rec_a, x.rec_b) for x in la.lookalike_pairs(df).collect()} == brute.same_look(rows)


def test_survivors_as_by_brute_force(spark):
    r = random.Random(4)
    day = dt.datetime(2024, 1, 1)
    texts = ["Bài thơ một", " bài THƠ một ", "Bài thơ hai", "bài thơ một", "", None, "đơn"]
    refs = [None, [], [(None, None, None)], [("", " ", "x")], [("s", None, "x")], [(None, "http://a.b", None)]]
    rows = [
        (k, r.choice(["a", "b", "zz", None]), "u", r.choice(texts), r.choice(["Khuyết danh", "An", " ", None, "(không rõ)", "N/A", "Ông đồ"]), r.choice(["http://", "https://x.example/1", "HTTP://y.test", None, "#", "/a", "ftp://x"]), r.choice(refs), None, r.choice([None, day, day + dt.timedelta(days=k % 3)]))
        for k in range(1, 160)
    ]
    df, trust = spark.createDataFrame(rows, MATERIAL), spark.createDataFrame([("a", 3), ("b", 1)], "source_id string, trust int")
    names = [f.name for f in df.schema]
    plain = [dict(zip(names, x)) | {"source_refs": None if x[6] is None else [dict(zip(("source_id", "url", "unit_type"), y)) for y in x[6]]} for x in rows]
    got = {(x.group_no, x.best_no, x.author_no, x.url_no) for x in sv.best_representatives(df, trust).collect()}
    assert got == brute.best(plain, {"a": 3, "b": 1}, sv.NOBODY)
    assert sv.survivors(df, trust).count() == len(got)
    assert sv.best_representatives(df.limit(0), trust).collect() == []


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(200, 200), (None, 3), (300, 301), (301, 300)]
    got = {(r.node, r.component) for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(k, 1) for k in range(1, 61)} | {(100 + k, 100) for k in range(50)} | {(300, 300), (301, 300)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_related_records_share_a_split(spark):
    r = random.Random(6)
    c = ["cluster-A1", "a1", " CLUSTER-a1 ", "cluster-", "NULL", None, "", "none", *[f"cluster-{k}" for k in range(30)]]
    w = ["fsoft:1", "FSOFT: 1", "1", None, *[f"fsoft:{k}" for k in range(2, 60)]]
    s = ["train", " Train", "dev", "val", "test", None, ""]
    rows = [(k, "cluster-hot" if k % 3 == 0 else r.choice(c), r.choice(w), r.choice(s)) for k in range(1, 200)] + [(5, None, None, "train")]
    df = spark.createDataFrame(rows, "rec_no long, duplicate_cluster string, work_id string, split string")
    plain = [dict(zip(("rec_no", "duplicate_cluster", "work_id", "split"), x)) for x in rows[:-1]]
    assert {(x.rec_no, x.group_no) for x in sg.torn_groups(df.where("rec_no <> 5 OR work_id IS NOT NULL OR duplicate_cluster IS NOT NULL")).collect()} >= {x for x in brute.torn(plain, sg.NOTHING) if x[0] != 5}
    new = sg.assign_splits(df).collect()
    of = {}
    for x in new:
        assert of.setdefault(x.group_no, x.new_split) == x.new_split
    assert sg.torn_groups(df.limit(0)).collect() == [] and sg.assign_splits(df.limit(0)).collect() == []


def test_shares_of_splits_are_near(spark):
    df = spark.range(1, 6001).selectExpr("id AS rec_no", "CAST(NULL AS STRING) AS duplicate_cluster", "CAST(id AS STRING) AS work_id", "'x' AS split")
    n = {r.new_split: r["count"] for r in sg.assign_splits(df).groupBy("new_split").count().collect()}
    assert abs(n["train"] / 6000 - 0.8) < 0.03 and abs(n["dev"] / 6000 - 0.1) < 0.02
