import json

import pytest
from pyspark.sql import functions as F

from versemill.functions import registry
from versemill.sources import html, readers, writers
from versemill.streaming import poems as st


def rows_of(spark, lines):
    return spark.createDataFrame([("f", k, x) for k, x in enumerate(lines)], "file string, ord int, line string")


def test_poems_by_genre(spark, tmp_path):
    spark.createDataFrame([("Luc_bat ", "a"), ("bay_chu", "b"), ("luc_bat", None)], "the_loai string, text string").write.parquet(str(tmp_path / "p"))
    assert [r.text for r in readers.poems_parquet(spark, str(tmp_path / "p")).collect()] == ["a"]
    (tmp_path / "c.csv").write_text('genre,content\nlục bát,"một\nhai"\nsong thất lục bát,x\n', encoding="utf-8")
    assert [r.text for r in readers.poems_csv(spark, str(tmp_path / "c.csv")).collect()] == ["một\nhai"]
    assert readers.text_block(spark, str(tmp_path / "c.csv")).count() == 1


def test_staging_reviews_and_lists(spark, tmp_path):
    (tmp_path / "s.csv").write_text("id,content,title,url,genre\n1,a  b,t,u,Luc  Bat\n2,c,t,u,khác\n3,,t,u,luc bat\n", encoding="utf-8")
    kept, seen = readers.staging_csv(spark, str(tmp_path / "s.csv"))
    assert [(r.id, r.text) for r in kept.collect()] == [("1", "a b")]
    assert {(r.genre, r.n) for r in seen.collect()} == {("luc bat", 2), ("khác", 1)}
    (tmp_path / "r.csv").write_text("﻿review_id,modecision_accept_reject\n1, accept\n2,\n", encoding="utf-8")
    assert [r.decision for r in readers.review_csv(spark, str(tmp_path / "r.csv")).orderBy("review_id").collect()] == ["ACCEPT", ""]
    with pytest.raises(ValueError):
        readers.review_csv(spark, str(tmp_path / "s.csv"))
    (tmp_path / "l.txt").write_text("# x\n\n  mây trắng \nnắng\n", encoding="utf-8")
    assert readers.phrase_list(spark, str(tmp_path / "l.txt")) == ["mây trắng", "nắng"]
    (tmp_path / "d.json").write_text(json.dumps([{"prompt_id": "p", "prompt": "q", "candidates": [{"poem": "a"}, {"poem": "b"}]}]), encoding="utf-8")
    assert [(r.idx, r.poem) for r in readers.candidate_dump(spark, str(tmp_path / "d.json")).orderBy("idx").collect()] == [(0, "a"), (1, "b")]


def test_labeled_paste(spark):
    lines = ["lạc", "Nguồn: https://a.b/1", "Thơ chúc Tết ông bà", "1.", "câu một", "câu hai", "", "câu ba", "Bài thơ 2", "câu bốn", "---", "NGUỒN : http://c.d", "“câu năm”", "Bài thơ chúc Tết hay", "câu sáu"]
    got = [(r.url, r.category, r.label, r.lines) for r in readers.labeled_paste(rows_of(spark, lines)).orderBy("ord").collect()]
    assert got == [
        ("https://a.b/1", "Thơ chúc Tết ông bà", "Bài 1", ["câu một", "câu hai"]),
        ("https://a.b/1", "Thơ chúc Tết ông bà", "Bài 1", ["câu ba"]),
        ("https://a.b/1", "Thơ chúc Tết ông bà", "Bài 2", ["câu bốn"]),
        ("http://c.d", None, None, ["câu năm"]),
        ("http://c.d", None, "Bài thơ chúc Tết hay", ["câu sáu"]),
    ]


def test_manual_paste(spark):
    lines = ["1. câu một", "", "2) câu hai", "Nguồn: https://a.b/1", "Tác giả: An", "câu ba", "———", "câu bốn", "Bài 3: x", "Tác giả:", "câu năm"]
    got = [(r.url, r.author, r.lines) for r in readers.manual_paste(rows_of(spark, lines)).orderBy("ord").collect()]
    assert got == [("manual:unknown", None, ["câu một", "câu hai"]), ("https://a.b/1", "An", ["câu ba"]), ("https://a.b/1", "An", ["câu bốn"]), ("https://a.b/1", None, ["câu năm"])]


def test_pages(spark):
    page = "<html><head><meta property='og:title' content=' T '><meta name=author content=An><style>x</style></head><body><nav>no<p>no</nav><p>một  hai<br>ba<div>bốn &amp; năm</div><script>if (a<b) {}</script></body>"
    r = html.page_lines(spark.createDataFrame([(page,), (None,), ("",)], "html string")).collect()
    assert r[0].page.lines == ["một hai", "ba", "bốn & năm"] and (r[0].title, r[0].author) == ("T", "An")
    assert r[1].page is None and r[2].page.lines == [] and r[2].title == ""


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", "dev"), (1, "a", "train")], "id int, text string, split string")
    writers.write_jsonl(df, str(tmp_path / "j"), "id")
    assert [json.loads(x)["id"] for f in sorted((tmp_path / "j").glob("part*")) for x in f.read_text().splitlines()] == [1, 2]
    writers.write_splits(df, str(tmp_path / "s"))
    assert (tmp_path / "s" / "split=dev").exists()
    with pytest.raises(Exception, match="unknown split"):
        writers.write_splits(df.withColumn("split", F.lit("x")), str(tmp_path / "t"))
    form = writers.review_form(df, "id", ["id", "text"], ["decision"]).collect()
    assert sorted(r.review_id for r in form) == ["DA001", "DA002"] and form[0].decision == ""


def test_sql_functions(spark):
    registry.register(spark)
    r = spark.sql("SELECT lb_tone('trời') AS t, lb_rhyme('người') AS r, lb_rhyme_kind('trời', 'người') AS k, lb_tokens(' Trời, xanh! ') AS w").first()
    assert (r.t, r.r, r.k, r.w) == ("huyền", "ươi", "slant", ["trời", "xanh"])
    assert [x.line for x in spark.sql("SELECT line FROM lb_lines('a\nb') ORDER BY pos").collect()] == ["a", "b"]


def test_streams_score_and_drop_repeats(spark, tmp_path):
    from tests.test_verse import GOOD

    rows = spark.createDataFrame([(GOOD, "2024-01-01 00:10:00"), (GOOD + "\n", "2024-01-01 00:20:00"), ("không phải thơ", "2024-01-01 01:30:00")], "text string, at string").selectExpr("text", "CAST(at AS TIMESTAMP) AS at")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = st.scored(st.first_seen(stream, "text", "at")).select("text", "ev.overall", "reasons").writeStream.format("memory").queryName("scored").start()
    query.processAllAvailable()
    query.stop()
    got = spark.sql("SELECT overall, reasons FROM scored").collect()
    assert len(got) == 2 and {r.overall for r in got} >= {100.0}
    query = st.reason_counts(st.scored(stream), "at").writeStream.outputMode("complete").format("memory").queryName("counted").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.reason, r.n) for r in spark.sql("SELECT reason, n FROM counted").collect()} >= {("accepted", 2), ("structure", 1)}
