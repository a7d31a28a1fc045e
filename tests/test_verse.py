import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from versemill.functions import phonetics as ph
from versemill.functions import tables as T
from versemill.functions import text as tx
from versemill.operators import collocation as co
from versemill.operators import evaluate as ev
from versemill.operators import lexical as lx
from versemill.operators import lines as ln

GOOD = "Trăm năm trong cõi người ta\nChữ tài chữ mệnh khéo là ghét nhau\nTrải qua một cuộc bể dâu\nNhững điều trông thấy mà đau đớn lòng"
BROKEN = "Trăm năm trong cõi người ta\nChữ tài chữ mệnh khéo là ghét nhau xa\nTrải qua một cuộc bể vần\nNhững điều trông trông mà đau đớn lòng"


def values(spark, f, words):
    df = spark.createDataFrame(list(enumerate(words)), "k int, w string")
    return [r.v for r in df.select("k", f(tx.normalize_text(F.col("w"))).alias("v")).orderBy("k").collect()]


def test_tones(spark):
    want = {"trời": "huyền", "mây": "ngang", "nắng": "sắc", "cả": "hỏi", "bão": "ngã", "bạn": "nặng", "": "unknown", " TRỜI ": "huyền", "café": "sắc", "über": "ngang", "mañana": "ngã", None: "unknown"}
    assert values(spark, ph.tone, want) == list(want.values())
    assert values(spark, ph.tone_bit, ["mây", "trời", "nắng", ""]) == [0, 1, 2, None]
    assert values(spark, ph.tone, [unicodedata.normalize("NFD", "trời")]) == ["huyền"]


def test_rhymes(spark):
    want = {"cành": "anh", "hành": "anh", "trời": "ơi", "người": "ươi", "thu": "u", "sương": "ương", "gì": "", "gìn": "n", "quê": "ê", "hoan": "an", "xuân": "ân", "hoa": "oa", "nghiêng": "iêng"}
    assert values(spark, ph.rhyme, want) == list(want.values())
    pairs = [("cành", "hành", "exact"), ("trời", "người", "slant"), ("thềm", "đêm", None), ("anh", "lang", "slant"), ("xanh", "bàng", "slant"), ("cành", "sương", None), ("gì", "gì", None)]
    df = spark.createDataFrame(pairs, "a string, b string, want string")
    got = df.select("a", "b", ph.rhyme_kind(F.col("a"), F.col("b")).alias("k"), ph.rhyme_kind(F.col("a"), F.col("b"), True).alias("s")).collect()
    assert {(r.a, r.b): r.k for r in got if r.a != "thềm"} == {(a, b): k for a, b, k in pairs if a != "thềm"}
    assert all((r.s == "exact") == (r.k == "exact") for r in got)
    raw = spark.createDataFrame([("uân", "ân"), ("au", "âu"), ("", "an"), ("anh", "âng")], "a string, b string")
    assert [r.k for r in raw.select(ph.rhyme_kind_extracted(F.col("a"), F.col("b")).alias("k")).collect()] == ["slant", "slant", None, None]


def test_syllables(spark):
    good, bad = ["bề", "nghiêng", "rượu", "người", "khuya"], ["đầụ", "gầntừng", "just", "wolf", "", "a1", "b-c"]
    assert values(spark, ph.is_syllable, good) == [True] * 5
    assert values(spark, ph.is_syllable, bad) == [False] * 7
    assert values(spark, ph.is_lexicon_syllable, ["b", "chk", "angkor", "thaooooo", "muười", "nghĩa"]) == [False] * 5 + [True]


def test_random_syllables_as_in_plain_python(spark):
    r = random.Random(1)
    letters = [c for c in T.SYLLABLE_LETTERS] + list("fjw1éñü") + list(T.TONE_MARKS)
    words = ["".join(r.choice(letters) for _ in range(r.randint(0, 7))) for _ in range(400)]
    nfc = [unicodedata.normalize("NFC", w.lower()) for w in words]
    marks = [[T.TONE_MARKS[c] for c in unicodedata.normalize("NFD", w) if c in T.TONE_MARKS] for w in nfc]
    assert values(spark, ph.tone, words) == [m[0] if m else ("ngang" if w else "unknown") for w, m in zip(nfc, marks)]
    assert values(spark, ph.tone_marks, words) == [len(m) for m in marks]


def test_tokens_and_texts(spark):
    df = spark.createDataFrame([("  «Trời», XANH… — ",), (None,), ("a​b",)], "t string")
    assert [r.v for r in df.select(tx.tokens(F.col("t")).alias("v")).collect()] == [["trời", "xanh"], None, ["a​b"]]
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t")).alias("v")).first().v
    assert one(tx.staged, "a  b\r\n\r\n c\rd") == "a b\nc\nd"
    assert one(tx.poem_text, " THƠ lục  bát:  trời ") == "trời"
    assert one(tx.terms, "Đường đi, đường về ở x") == ["duong", "di", "ve"]


def evaluated(spark, rows, expected=None):
    df = ev.evaluate(spark.createDataFrame(rows, "k int, text string"), expected=expected)
    return {r.k: r.ev for r in df.collect()}


def test_scores(spark):
    lines = GOOD.split("\n")
    got = evaluated(spark, [(1, GOOD), (2, BROKEN), (3, "\n".join(lines[:2])), (4, "đây là văn xuôi"), (5, "\n".join([lines[0]] * 2)), (6, "\n".join([lines[1], lines[0]])), (7, "\n".join(lines[:3])), (8, None), (9, ""), (10, "\n \n" + GOOD + "\n\n")])
    g = got[1]
    assert (g.scr, g.tcr, g.rma, g.overall, g.is_valid, g.num_lines) == (100, 100, 100, 100, True, 4)
    assert (g.exact_rma, g.slant_rma) == (33.33, 66.67)
    b = got[2]
    assert (b.scr, b.tcr, b.rma, b.overall, b.is_valid) == (75, 90, 0, 57, False)
    assert (got[3].scr, got[3].rma) == (100, 100)
    assert got[4].scr == 0 and got[5].scr == 50 and got[6].scr == 0
    assert (got[7].scr, got[7].rma, got[7].errors[0]) == (66.67, 0, "incomplete_couplet")
    assert got[8] is None and (got[9].errors, got[9].overall) == (["empty_poem"], 0)
    assert got[10].overall == 100
    six = evaluated(spark, [(1, GOOD)], 6)[1]
    assert six.scr == 66.67 and "line_count_mismatch" in six.errors
    with pytest.raises(ValueError):
        evaluated(spark, [(1, GOOD)], 0)


def test_gate(spark):
    twice = GOOD + "\n" + GOOD
    df = spark.createDataFrame([(1, GOOD), (2, twice), (3, "gió gió gió gió gió gió"), (4, BROKEN)], "k int, text string")
    got = {r.k: r.reasons for r in ev.quality_reasons(ev.evaluate(df)).collect()}
    assert got[1] == [] and "repeated_line" in got[2] and {"structure", "repeated_token_run"} <= set(got[3]) and {"structure", "tone", "rhyme"} <= set(got[4])


def test_trace_is_the_automaton_run_step_by_step(spark):
    text = GOOD.replace("\n", " ") + "\nmột câu dở dang"
    got = {r.i: r for r in ev.prosody_trace(spark.createDataFrame([(1, text)], "k int, text string"), "k").collect()}
    line, place, anchor6, anchor8, six = "luc", 1, None, None, None
    for i in range(len(got)):
        r = got[i]
        tone = {2: "B", 4: "T", 6: "B"}.get(place)
        if line == "bat" and place == 8:
            tone = {"ngang": "HUYEN", "huyền": "NGANG"}.get(six, "B")
        rhyme = (anchor8 if line == "luc" else anchor6) if place == 6 else None
        assert (r.line_type, r.place, r.required_tone, r.required_rhyme) == (line, place, tone, rhyme)
        if line == "luc":
            anchor6 = r.rhyme if place == 6 else anchor6
        else:
            six, anchor8 = (r.tone if place == 6 else six), (r.rhyme if place == 8 else anchor8)
        place += 1
        if place > (6 if line == "luc" else 8):
            line, place = ("bat" if line == "luc" else "luc"), 1


def test_scaffolds(spark):
    rows = [("xuân", "xuân", "nhà", "qua", "ca"), ("xuân", "xuân", "qua", "nhà", "ca"), ("xuân", "tết", "nhà", "qua", "ca"), ("hai từ", "xuân", "nhà", "qua", "ca"), (None, "xuân", "nhà", "qua", "ca"), ("sông", "xuân", "nhà", "qua", "ca")]
    df = ev.resolve_scaffold(spark.createDataFrame(rows, "a string, b string, c string, d string, e string"), list("abcde"))
    got = [(r.scaffold_source, r.scaffold_reason) for r in df.collect()]
    assert got[0] == ("validated", None) and got[1][1] == "line_2_bang_pair_must_alternate" and got[2][1] == "anchor_not_bang:line_2_sixth"
    assert got[3][1] == "line_1_end_must_be_one_syllable" and got[4][1] == "invalid_scaffold_schema" and got[5][1].startswith("rhyme_mismatch:line_1_end:line_2_sixth")
    assert all(r.scaffold == T.DEFAULT_SCAFFOLD for r in df.where("scaffold_source = 'fallback'").collect())


def test_guard_and_coverage(spark):
    df = spark.createDataFrame([("ngày xuân ơ mai và", ["mai vàng", "lộc"], "Chúc ông bà khỏe"), ("Bà ông vui mai\nvàng lộc biếc", ["mai vàng", "lộc xuân"], "chúc con cháu và ông bà"), (None, ["a b"], None)], "text string, keys array<string>, wish string")
    got = lx.coverage(lx.assess(df, "text", "keys"), "text", "wish", "keys").collect()
    assert (got[0].orphans, got[0].truncated, got[0].hard_fail) == (["ơ"], ["mai và"], True)
    assert got[0].coverage.reasons == ["missing_recipient", "no_exact_keyword", "insufficient_semantic_keywords"]
    assert got[1].hard_fail is False and got[1].coverage.exact_count == 1 and got[1].coverage.semantic_count == 2
    assert got[1].coverage.recipients == ["ông bà", "con cháu"] and got[1].coverage.missing == ["con cháu"]
    assert got[2].hard_fail is False and got[2].coverage.exact_count == 0


def test_couplets_windows_blocks(spark):
    df = spark.createDataFrame([(1, GOOD + "\nngắn thôi\n" + GOOD), (2, None), (3, "")], "k long, text string")
    got = ln.couplets(df, "k").orderBy("nth").collect()
    assert len(got) == 4 and [r.next6 for r in got] == [*[r.l6 for r in got[1:]], None]
    rows = ln.rendered_lines(df, "k")
    assert ln.windows(rows).count() == 6
    blocks = {r.block: r for r in ln.blocks(rows).collect()}
    assert [blocks[k].kind for k in (1, 2)] == ["derived_leading", "derived_interior"] and blocks[1].remainder == 1
    offsets = spark.createDataFrame([([7, 0, 3, 4, 5, 9],)], "o array<int>")
    assert offsets.select(ln.greedy(F.col("o")).alias("v")).first().v == [0, 4, 9]


def test_collocation(spark):
    df = spark.createDataFrame([(1, "trời xanh mây\ntrời xanh"), (2, "một"), (3, None)], "k long, text string")
    rows = co.line_words(df, "k")
    uni, bi = co.counts(rows)
    assert {(r.left, r.right): r.n for r in bi.collect()} == {("trời", "xanh"): 2, ("xanh", "mây"): 1}
    s = co.poem_scores(co.scored_bigrams(rows, uni, bi)).collect()
    assert [r.id for r in s] == [1] and s[0].unseen == 0 and s[0].rare == round(1 / 3, 4)
