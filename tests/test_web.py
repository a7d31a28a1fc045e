import pytest
from pyspark.sql import functions as F

from tests.test_verse import BROKEN, GOOD
from versemill.operators import decode as dc
from versemill.operators import lines as ln
from versemill.operators import trie as tr
from versemill.operators import web


def test_windows_are_kept_once_and_apart(spark):
    low = "Trăm năm trong cõi người xa\nChữ tài chữ mệnh khéo là ghét nhau\nTrải qua một cuộc bể hoa\nNhững điều trông thấy mà đau đớn lòng"
    rows = [(1, 0, GOOD), (1, 2, low), (1, 4, GOOD.upper()), (1, 5, low), (2, 0, GOOD), (2, 1, BROKEN), (2, 6, low), (3, 0, "x")]
    got = {(r.id, r.pos): (r.bucket, r.review_reason) for r in web.select_windows(spark.createDataFrame(rows, "id int, pos int, window string")).collect()}
    assert got[1, 0] == ("accepted", "") and (1, 4) not in got and (2, 0) not in got and (2, 1) not in got and (1, 2) not in got
    # the second of two equal windows of a page is gone before overlaps are looked at
    assert (1, 5) not in got and got[2, 6][0] in ("accepted", "review")


def test_one_to_one_selections(spark):
    a = spark.createDataFrame([(1, "p", "x"), (2, "q", "y")], "k int, prompt string, poem string")
    assert web.paired_selections(a, a, "k", ["prompt"]).count() == 2
    with pytest.raises(Exception, match="no match"):
        web.paired_selections(a, a.where("k = 1"), "k", ["prompt"]).collect()
    with pytest.raises(Exception, match="no match"):
        web.paired_selections(a, a.withColumn("prompt", F.lit("z")), "k", ["prompt"]).collect()
    assert [(r.k, r.ord) for r in web.chosen(a, [2, 1], "k").orderBy("ord").collect()] == [(2, 0), (1, 1)]
    with pytest.raises(ValueError, match="missing"):
        web.chosen(a, [3], "k")
    assert web.in_both(a, a.where("k = 2"), ["k"]).collect() == [(2,)]


def trie(spark):
    words = sorted({w for w in GOOD.lower().replace("\n", " ").split()})
    groups = ln.rhyme_dictionary(spark.createDataFrame([(w, w) for w in words], "w1 string, w2 string"))
    return tr.nodes(tr.attributed(tr.spelled(spark.createDataFrame([(w,) for w in words], "syllable string")), groups))


def test_decoder_allows_good_verse_only(spark):
    nodes = trie(spark)
    bad = GOOD.lower().replace("người ta\n", "người ta trời\n")
    rows = spark.createDataFrame([(1, list(GOOD.lower())), (2, list(bad)), (3, list("tră")), (4, list("tră ta"))], "id int, tokens array<string>")
    got = {}
    for r in dc.traced(rows, nodes).collect():
        got.setdefault(r.id, []).append(r)
    assert all(r.allowed for r in got[1]) and sum(r.penalty for r in got[1]) == 0
    assert any(not r.allowed for r in got[2])
    assert all(r.allowed for r in got[3]) and [r.token for r in got[4] if not r.allowed] == [" "]
    assert len(got[1]) == len(GOOD)


def test_what_may_follow(spark):
    nodes = trie(spark)
    states = spark.createDataFrame([(1, 0, ""), (2, 0, dc.SEP.join("ta")), (3, 0, dc.SEP.join("tră"))], "state int, root int, path string")
    got = {}
    for r in dc.next_tokens(states, nodes).collect():
        got.setdefault(r.state, set()).add(r.token)
    assert got[3] == {"m"} and " " in got[2] and "t" in got[1] and " " not in got[1]
    df = spark.createDataFrame([(1,), (2,), (3,)], "a int")
    assert [r.p for r in df.select(dc.retry_penalty(F.col("a")).alias("p")).collect()] == [3.0, 4.5, 6.0]
