import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.test_verse import BROKEN, GOOD
from versemill.operators import agent as ag
from versemill.operators import audit as au
from versemill.operators import dedup as dd
from versemill.operators import rank as rk
from versemill.operators import sample as sm
from versemill.operators import trie as tr


def test_ranking(spark):
    rows = [(1, 0, BROKEN, ["trăm năm"]), (1, 1, GOOD, ["trăm năm"]), (1, 2, GOOD + " ơ", ["trăm năm"]), (2, 0, GOOD, []), (2, 1, GOOD, [])]
    df = rk.components(spark.createDataFrame(rows, "pool int, idx int, text string, keys array<string>"), "text", "keys", F.lit(4), ["Bể Dâu", "không có"])
    df = rk.rerank(rk.guarded(df, "text", "keys").withColumn("score", rk.total(F.col("parts"))), guard="hard_fail")
    got = {(r.pool, r.idx): r for r in df.collect()}
    assert [got[1, k].place for k in (0, 1, 2)] == [2, 1, 3] and got[1, 2].hard_fail
    assert [got[2, k].place for k in (0, 1)] == [1, 2]
    p = got[1, 1].parts
    assert (p.evaluator, p.cliche, p.keyword, p.length) == (1, -0.25, 1, 1) and got[2, 0].parts.keyword == 0.5
    sweep = rk.sweep(df, {"a": {"evaluator": 1.0}, "b": {"cliche": 1.0}}).collect()
    assert {r.weights: r.pools for r in sweep} == {"a": 2, "b": 2}
    flat = df.groupBy("pool").agg(rk.pearson(F.col("score"), F.lit(1.0)).alias("c")).collect()
    assert {r.c for r in flat} == {0.0}


def test_simhash_pairs_and_clusters(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(12)]
    values = base + [b ^ sum(1 << k for k in r.sample(range(64), n)) for b in base for n in (1, 2, 3, 4)] + [base[0]] * 5 + [base[1] & ~0xFFFF | r.getrandbits(16) for _ in range(60)]
    rows = [(k, v >> 32, v & 0xFFFFFFFF) for k, v in enumerate(values)]
    least = {}
    for k, v in enumerate(values):
        least.setdefault(v, k)
    want = {(a, b) for (u, a), (v, b) in itertools.permutations(least.items(), 2) if a < b and (u ^ v).bit_count() <= 3}
    df = spark.createDataFrame(rows, "id long, hi long, lo long")
    for bucket in (128, 4):
        members, pairs = dd.near_pairs(df, bucket=bucket)
        assert {(p.a, p.b) for p in pairs.collect()} == want
    named = {c.id: c.cluster for c in dd.clusters(members, pairs).collect()}
    assert len(named) == len(rows) and named[0] == "cluster-" + hashlib.sha256(b"0").hexdigest()[:16] and len({named[k] for k, v in enumerate(values) if v == base[0]}) == 1


def test_simhash_of_nothing_sets_all_bits(spark):
    df = spark.createDataFrame([(1, ""), (2, "một hai"), (3, "hai một hai"), (4, None)], "k long, text string")
    got = {r.id: (r.hi, r.lo) for r in dd.simhash(df, "k").collect()}
    assert got[1] == (2**32 - 1, 2**32 - 1) and got[2] == got[3] and 4 not in got


def test_splits_leaks_samples(spark):
    df = spark.createDataFrame([("a", "train", 4), ("a", "dev", 4), ("b", "test", 6), (None, "dev", 8)] * 3, "c string, s string, n int").withColumn("id", F.monotonically_increasing_id())
    assert [(r.cluster, r.splits) for r in dd.leaks(df, "c", "s").collect()] == [("a", 2)]
    point = int(hashlib.sha256(b"a").hexdigest()[:8], 16) / 0xFFFFFFFF
    assert df.select(dd.hash_split(F.lit("a")).alias("v")).first().v == ("train" if point < 0.8 else "dev" if point < 0.9 else "test")
    assert [r.place for r in sm.lowest(df, "id", 3).collect()] == [1, 2, 3]
    assert sm.even_quotas(8) == {4: 3, 6: 3, 8: 2}
    got = sm.quotas(df, "n", {4: 2, 6: 5}, "id")
    assert got.groupBy("n").count().orderBy("n").collect() == [(4, 2), (6, 3)]
    assert [(r.n, r.have) for r in sm.shortfall(got, "n", {4: 2, 6: 5}).collect()] == [(6, 3)]
    form, key = sm.blind_pairs(df.select("id", "c", "s"), "id", "c", "s", 1)
    for r in form.join(key, "item").join(df, "id").collect():
        assert (r.a, r.b) == ((r.c, r.s) if r.a_is_left else (r.s, r.c))


def test_requests_and_raw_output(spark):
    df = spark.createDataFrame([("Viết bài thơ 6 câu về mùa xuân, vần an nhé",), ("chúc Tết",)], "p string")
    got = [r.m for r in df.select(ag.parse_request(F.col("p")).alias("m")).collect()]
    assert (got[0].num_lines, got[0].rhyme, got[0].keywords[:2]) == (6, "an", ["mùa", "xuân"]) and (got[1].num_lines, got[1].rhyme) == (4, None)
    raw = "<THINK>x\ny</think>Chủ đề: z\n\n<answer> một \r\nhai</answer>\nba"
    assert spark.createDataFrame([(raw,)], "r string").select(ag.extract_poem(F.col("r"), 2).alias("v")).first().v == "một\nhai"
    kept, ok = ag.clean_keywords(F.col("k"))
    rows = spark.createDataFrame([([" mai  vàng", "MAI VÀNG", "lộc"],), (["a"],)], "k array<string>").select(kept.alias("k"), ok.alias("ok")).collect()
    assert [(r.k, r.ok) for r in rows] == [(["mai vàng", "lộc"], True), (["a"], False)]


def test_verdicts_are_saved_as_rejections_only(spark):
    rows = ['x {"decision": "accept", "issues": [], "repair_instruction": ""} y', '{"decision": "reject", "issues": ["từ "lạ""], "repair_instruction": "sửa"}', '{"decision": "accept", "issues": ["a "b""], "repair_instruction": "c"}', "không", None]
    got = [r.c for r in spark.createDataFrame([(r,) for r in rows], "r string").select(ag.parse_critic(F.col("r")).alias("c")).collect()]
    assert got[0].decision == "accept" and got[1].decision == "reject" and got[1].repair_instruction == "sửa" and got[2:] == [None, None, None]


def test_metadata_faults(spark):
    cols = "i string, r string, k array<string>, n int, v string"
    rows = [(" chúc  vui ", "ông bà", ["a", "b"], None, None), ("", None, ["a", "b"], 4, None), ("x", None, ["a", "A"], 4, None), ("x", None, ["a", "b"], 6, None), ("x", None, ["a", "b"], 4, "v9")]
    got = [r.m for r in spark.createDataFrame(rows, cols).select(ag.normalize_metadata(*map(F.col, "irknv")).alias("m")).collect()]
    assert (got[0].wish_intent, got[0].fault) == ("Chúc ông bà: chúc vui", None) and [m.fault for m in got[1:]] == ["wish_intent", "keywords", "num_lines", "protocol_version"]


def test_topics_answers_and_manifests(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t")).alias("v")).first().v
    assert one(ag.request_topic, " Viết bài thơ lục bát 6 câu về mùa xuân..") == "mùa xuân"
    assert one(ag.clean_output, "a</think>b</think> ... nghe mưa") == "Nghe mưa" and one(ag.clean_output, "") == ""
    cols = "id string, prompt string, wish_intent string, recipient string, keywords array<string>, num_lines int, protocol_version string"
    rows = [("a", "p", "w", None, ["x", "y"], 4, None), ("b", " ", "w", None, ["x", "y"], 4, None), ("c", "p", "w", None, ["x"], 4, None), ("d", "p", "w", None, ["x", "y"], 4, None), ("d", "p", "w", None, ["x", "y"], 4, None)]
    df = spark.createDataFrame(rows, cols)
    assert {(r.id, r.fault) for r in ag.manifest_faults(df, F.lit("tet4-v1"), F.lit("dev"), "dev").collect()} == {("b", "prompt"), ("c", "keywords"), ("d", "repeated_id")}
    assert {r.fault for r in ag.manifest_faults(df, F.lit("v0"), F.lit("dev")).collect()} == {"version"}
    text = df.select(ag.coverage_instruction(F.array(F.lit("ông bà")), F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("v")).first().v
    assert text == "Ràng buộc nội dung: phải nhắc rõ ông bà; phải dùng nguyên văn ít nhất một từ khoá: a, b, c; phải phủ ít nhất 2/3 ý từ khoá; phần còn lại được paraphrase."


def test_audits_and_tallies(spark):
    rows = [("4", "3", "0", "accept")] * 8 + [("2", "2", "1", "reject")] * 2
    r = au.audit_summary(spark.createDataFrame(rows, "a string, b string, c string, d string"), "a", "b", "c", "d").first()
    assert (r.n, r.accepted, r.sensitive, r.accept_rate, r.gate_passed) == (10, 8, 2, 0.8, True)
    ratings = spark.createDataFrame([(1, "A"), (2, "B"), (3, "TIE")], "pair_id int, preference string")
    key = spark.createDataFrame([(1, "base", "tuned"), (2, "base", "tuned"), (3, "tuned", "base")], "pair_id int, a_is string, b_is string")
    assert {(r.winner, r.n) for r in au.paired_tally(ratings, key).collect()} == {("base", 1), ("tuned", 1), ("tie", 1)}
    with pytest.raises(Exception, match="different pairs"):
        au.paired_tally(ratings.limit(2), key).collect()
    notes = spark.createDataFrame([("a",), ("B - hay hơn",), ("Tie",), ("T...",), (None,)], "v string")
    assert [r.v for r in notes.select(au.choice(F.col("v")).alias("v")).collect()] == ["A", "B", "TIE", None, None]


def test_trie_and_matching(spark):
    groups = spark.createDataFrame([("an", ["lan"]), ("ân", ["sân"]), ("ang", ["vàng"]), ("âng", ["tầng"]), ("anh", ["xanh"])], "rhyme string, words array<string>")
    words = groups.select(F.explode("words").alias("syllable"))
    nodes = tr.nodes(tr.attributed(tr.spelled(words), groups))
    at = {(r.root, r.path.replace("\x01", "")): r for r in nodes.collect()}
    assert at[0, "lan"].complete and not at[0, "la"].complete and at[1, " v"].tone_bits == 2
    seq = spark.createDataFrame([(1, 0, list("lan")), (2, 0, list("la")), (3, 0, list("lax"))], "id int, root int, tokens array<string>")
    assert {r.id: r.allowed for r in tr.verify(seq, nodes).collect()} == {1: True, 2: False, 3: False}
    got = {(r.rhyme, r.other): r.kind for r in tr.matching_groups(groups, groups).collect()}
    assert got["an", "ân"] == got["anh", "ang"] == got["ang", "âng"] == "slant" and got["an", "an"] == "exact" and ("anh", "âng") not in got


def test_attempts(spark):
    df = spark.createDataFrame([(1, 1, True, True), (1, 2, True, False), (2, 1, False, None)], "pool int, attempt int, accepted boolean, vetoed boolean")
    assert {(r.pool, r.attempts, r.accepted_at) for r in ag.accepted_attempts(df).collect()} == {(1, 2, 2), (2, 1, None)}
