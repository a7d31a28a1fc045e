import os
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from versemill.llm import fingerprints as fp
from versemill.llm import shards as sh
from versemill.llm.near_duplicates import near_duplicate_groups, search_effort
from versemill.llm.split_overlap import cross_split_pairs, overlap_report

SF = "/root/testdata/sf0.1"


def poems(n, seed=1, vocabulary=60, length=24):
    """Poems of a small vocabulary, a third of them variants of one; many pairs near the threshold."""
    r = random.Random(seed)
    words = [f"từ{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(vocabulary)]
    base = [r.choice(words) for _ in range(length)]
    out = []
    for k in range(n):
        if k % 3 == 0:
            t = list(base)
            for _ in range(r.randint(0, 12)):
                t[r.randrange(len(t))] = r.choice(words)
            r.shuffle(t)
        elif k % 3 == 1 and out:
            t = out[r.randrange(len(out))].split()
            for _ in range(r.randint(0, 9)):
                t.insert(r.randrange(len(t) + 1), r.choice(words)) if r.random() < 0.3 else t.__setitem__(r.randrange(len(t)), r.choice(words))
        else:
            t = [r.choice(words) for _ in range(r.randint(8, 34))]
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("limit", [20_000, 12])
def test_groups_as_by_brute_force(spark, limit):
    """With a small limit shards are parted by a second word and then block by block."""
    rows = list(enumerate(poems(240), 1))
    want = set(brute.components(brute.near_pairs(rows)).items())
    got = near_duplicate_groups(spark.createDataFrame(rows, "rec_no long, text string"), limit=limit).collect()
    assert {(r.rec_no, r.group_no) for r in got} == want


def test_groups_of_edge_cases(spark):
    ten = "một hai ba bốn năm sáu bảy tám chín mười"
    rows = [
        (1, ten), (2, ten.upper()), (3, ten.replace("ố", "ố").replace(" ", " ")), (4, None), (5, ""), (6, "  \n"), (7, "một hai ba"),
        (8, "một hai ba"), (9, ten + " " + "x " * 40_000), (10, "ﾟ"), (1, ten), (None, ten), (11, " ".join(ten.split()[:7] + ["a", "b", "c"])), (12, " ".join(ten.split()[:6] + ["d", "e", "f", "g"])),
    ]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "rec_no long, text string, rep string")
    got = {(r.rec_no, r.group_no) for r in near_duplicate_groups(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (11, 1)}
    assert near_duplicate_groups(df.where("rec_no < 0")).collect() == []


def test_look_alikes_and_repeated_words(spark):
    a = "sông sông sông nước trời mây gió trăng sao đêm"
    rows = [(1, a), (2, a.replace("ô", "о̂")), (3, "sông nước trời mây gió trăng sao đêm ngày nắng mưa")]
    got = {(r.rec_no, r.group_no) for r in near_duplicate_groups(spark.createDataFrame(rows, "rec_no long, text string")).collect()}
    assert got == set(brute.components(brute.near_pairs(rows)).items()) and {(1, 1), (2, 1)} <= got


@pytest.mark.parametrize("leaf", [2, 8, 1000])
def test_tree_finds_every_near_duplicate_of_its_shards(monkeypatch, leaf):
    """Each near-duplicate pair comes out of the shard of its first common word, however deep the tree is."""
    monkeypatch.setattr(fp.Balls, "LEAF", leaf)
    texts = poems(260, seed=8, vocabulary=90) + ["a b c d e f g h i j " + "x " * 90, "a b c d e f g h i j y " + "x " * 90]
    offsets, terms = fp.term_arrays(pa.array(texts))
    n = np.diff(offsets)
    names, counts = np.unique(terms, return_counts=True)
    terms, place = sh.ranked(offsets, terms, (names, counts))
    short, shards = fp.short_hashes(terms), {}
    flipped = fp.prefix_parities(short)
    for r in range(len(n)):
        for at in range(offsets[r], offsets[r + 1]):
            if n[r] >= fp.MIN_WORDS and place[at] <= n[r] - fp.needed(n[r]):
                end = offsets[r] + n[r] - fp.needed(n[r]) + 1 + fp.Balls.DEPTH
                tail = short[at + 1 : end].tobytes() if end - at - 1 <= fp.Balls.TAIL else None
                shards.setdefault(terms[at], []).append((r, [f[offsets[r + 1]] ^ f[at + 1] for f in flipped], place[at], tail))
    found = set()
    for rows in shards.values():
        rec = np.array([x[0] for x in rows])
        balls = fp.Balls(*np.array([x[1] for x in rows], np.uint64).T, n[rec], np.array([x[2] for x in rows]), [x[3] for x in rows])
        for x, y in balls.pairs(np.arange(len(rec))):
            found |= {(min(p), max(p)) for p in zip(rec[x].tolist(), rec[y].tolist())}
    assert brute.near_pairs(list(enumerate(texts))) <= found


def test_branches_are_pruned_on_the_test_table(spark):
    if not os.path.exists(f"{SF}/tet4_web_staging_v1.parquet"):
        pytest.skip("no test tables here")
    got = search_effort(spark.read.parquet(f"{SF}/tet4_web_staging_v1.parquet")).where("records > 32").groupBy().sum("pairs", "compared", "splits").first()
    assert got[1] < got[0] / 2 and got[2] > 1000


def test_forest_of_a_dense_graph_spans_it():
    n = 400
    everything = np.arange(n)
    a, b = fp.forest(n, iter([(np.repeat(everything, n), np.tile(everything, n))]), neighbours=lambda p, left: np.ones(left.size, bool))
    assert len(a) < 2 * n
    assert len(set(brute.components(zip(a.tolist(), b.tolist())).values())) == 1


def test_cross_split_pairs_as_by_brute_force(spark):
    texts = poems(240, seed=5)
    names = ["train", " TRAIN", "dev", "Validation ", "test\n", None, "", "training", "other"]
    rows = [(k, t, names[(k * 7) % len(names)], f"s{k % 2}") for k, t in enumerate(texts, 1)] + [(500, None, "dev", None), (501, "", "train", None), (1, texts[0], names[7], "s1")]
    df = spark.createDataFrame(rows, "rec_no long, text string, split string, source_id string")
    side = {k: brute.split_of(s) for k, _, s, _ in rows}
    want = {p for p in brute.near_pairs([(k, t) for k, t, _, _ in rows]) if {side[p[0]], side[p[1]]} in ({"train", "dev"}, {"train", "test"})}
    for limit in (20_000, 12):
        assert {(r.rec_a, r.rec_b) for r in cross_split_pairs(df, limit=limit).collect()} == want
    hit = {x for p in want for x in p if side[x] != "train"}
    got = {(r.split, r.source): (r.records, r.overlapping) for r in overlap_report(df).collect()}
    assert sum(o for _, o in got.values()) == len(hit)
    assert sum(n for n, _ in got.values()) == sum(1 for k, _, s, _ in rows if brute.split_of(s) in ("dev", "test"))
    assert cross_split_pairs(df.limit(0)).collect() == []
