import os
import random
import time
from itertools import combinations

import pytest

from tests.llm import brute
from versemill.llm import encode, mix, spans

needs = pytest.mark.skipif(not os.path.exists(encode.VOCABULARY), reason="no vocabulary files here")
TEXTS = ["", None, " ", "a", "aaaa aaaaa aaaaaaaa", "Trời xanh mây trắng\n\n  bay.", "It's they'll WE'VE", "12345 ½ x²", "<|endoftext|> <|im_start|>", "日本語 テスト 🙂‍↔️🧧", "\r\n\t  x  ", "é à", "x" * 20_000, "\x00\x07"]


@needs
def test_ids_as_by_the_library_and_back(spark):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(encode.VOCABULARY.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(1, "again", "x"), (1, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, tuple(r.ids)) for r in encode.encode_corpus(df).collect())
    assert got == sorted((k, tuple(other.encode(t or "", add_special_tokens=False).ids)) for k, t, _ in rows)
    bpe = encode.replay(encode.vocabulary())
    for k, ids in got:
        assert b"".join(bpe.names[i] for i in ids).decode() in [t or "" for j, t, _ in rows if j == k]
    counts = sorted((r.doc_id, r.tokens) for r in encode.token_counts(df, ["doc_id"]).collect())
    assert counts == sorted((k, len(i)) for k, i in got)
    assert encode.encode_corpus(df.limit(0)).collect() == []


@needs
def test_replay_starts_over_without_changing_ids():
    r = random.Random(1)
    words = ["".join(r.choice("abc độ .,'1\n") for _ in range(r.randint(1, 12))) for _ in range(200)]
    bpe = encode.replay(encode.vocabulary())

    def ids(word):
        code = bpe.codes([word])[0]
        return bpe.flat[bpe.start[code] : bpe.start[code + 1]].tolist()

    whole = [ids(w) for w in words]
    bpe._clear()
    assert [ids(w) for w in words] == whole
    offsets, flat = bpe.run([w.encode() for w in words])
    assert [flat[s:e].tolist() for s, e in zip(offsets, offsets[1:])] == whole


@needs
def test_each_word_of_the_corpus_is_replayed_once_whatever_the_chunks(spark):
    texts = [f"từ {k % 7} nào cũng được {k}" for k in range(300)] + ["dài " * 300_000, None, "", "x" * 700_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    parted = encode.chunks(df, "doc_id", "text").collect()
    assert len({c.chunk for c in parted}) == len(parted) > 5 and sorted(k for c in parted for k in c["keys"]) == list(range(304))
    assert "".join(c.words[p] for c in parted for p in c.places) != "" and all(len(set(c.words)) == len(c.words) for c in parted)
    bpe = encode.replay(encode.vocabulary())
    for row in encode.encode_corpus(df).collect():
        assert b"".join(bpe.names[i] for i in row.ids).decode() == (texts[row.doc_id] or "")


@needs
def test_mix_reaches_shares_and_reports_short_sources(spark):
    rows = [(k, "từ nào cũng được " * (3 + k % 5), s) for k, s in enumerate(["big"] * 300 + [" Big "] * 20 + ["small"] * 20 + ["s-mall2"] * 60 + [None] * 5)] + [(900, None, "big"), (901, "", "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 2), ("s_mall2", 0.2, 2), ("gone", 0.1, 4)], "source string, target_share double, max_repeats int")
    assert {r.source for r in mix.short_sources(docs, targets).collect()} == {"small", "gone"}
    got = {r.source: r for r in mix.mix_shares(docs, targets, block_tokens=64).collect()}
    assert got["gone"].mixed_tokens == 0 and got["small"].rounds == 2
    assert abs(got["big"].mixed_tokens / got["s_mall2"].mixed_tokens - 2.5) < 0.3
    assert abs(sum(r.actual_share for r in got.values()) - 1) < 1e-4
    slots = mix.schedule(docs, targets, block_tokens=64).collect()
    assert len({s.slot for s in slots}) == len(slots)
    used = {}
    for s in slots:
        used[s.source, s.block] = used.get((s.source, s.block), 0) + 1
    assert max(used.values()) <= 2 and all(n == 1 for (s, _), n in used.items() if s == "big")
    assert mix.short_sources(docs.limit(0), targets).collect() == []
    assert {r.actual_share for r in mix.mix_shares(docs.limit(0), targets).collect()} == {0.0}


def span_rows(seed=9):
    r = random.Random(seed)
    letters = "abcdeđêơ 🙂\n"
    fresh = lambda n: "".join(r.choice(letters) for _ in range(n))
    notice, almost = fresh(100), fresh(99)
    rows = []
    for k in range(60):
        t = fresh(r.randint(0, 300))
        if k % 3 == 0:
            t += notice + fresh(r.randint(0, 40))
        if k % 3 == 1:
            t += almost + fresh(r.randint(0, 40))
        if k % 7 == 0 and rows:
            other = r.choice(rows)[1] or ""
            n = r.choice([98, 99, 100, 101, 140])
            s = r.randint(0, max(0, len(other) - n))
            t += other[s : s + n]
        rows.append((k + 1, t))
    return rows + [(100, None), (101, ""), (102, "z" * 500), (103, "z" * 120 + "y"), (104, rows[0][1]), (105, rows[0][1])]


def test_span_pairs_as_by_brute_force(spark, monkeypatch):
    rows = span_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.span_pairs(rows)
    assert {(r.doc_a, r.doc_b) for r in spans.span_pairs(df).collect()} == want
    assert spans.span_pairs(df.limit(0)).collect() == []


def test_hot_anchors_are_refined_exactly(spark):
    """More than PAIRED records share a run one code point too short, and two of them a long one."""
    r = random.Random(3)
    almost = "".join(r.choice("abcdefgh") for _ in range(99))
    rows = [(k, chr(0x4E00 + k) * 7 + almost + chr(0x5E00 + k) * 9) for k in range(1, 180)]
    rows += [(500, "Q" + almost + "R" * 9), (501, "SQ" + almost + "T")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(x.doc_a, x.doc_b) for x in spans.span_pairs(df).collect()} == {(500, 501)} == brute.span_pairs(rows)


def test_shared_amount_counts_each_place_once(spark):
    rows = span_rows(11)
    by = {}
    for k, t in rows:
        for i in range(len(t or "") - 99):
            by.setdefault(t[i : i + 100], set()).add(k)
    want = {}
    for k, t in rows:
        held = set()
        for i in range(len(t or "") - 99):
            if len(by[t[i : i + 100]]) > 1:
                held.update(range(i, i + 100))
        want[k] = (len(t or ""), len(held))
    first = {}
    for k, t in rows:
        if len(t or "") >= 100:
            first[t] = min(k, first.get(t, k))
    want = {k: (first.get(t), *want[k]) for k, t in rows}
    got = {r.doc_id: (r.class_no, r.n_chars, r.shared_chars) for r in spans.shared_amount(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_covers_hold_every_difference():
    for v, d in spans.COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_passages_as_by_brute_force(spark):
    rows = span_rows(12)
    first = {}
    for k, t in rows:
        first.setdefault(t, k)
    texts = {k: t for t, k in first.items() if len(t or "") >= 100}
    grams = {k: {t[i : i + 100] for i in range(len(t) - 99)} for k, t in texts.items()}
    want = set()
    for k, t in texts.items():
        for o in texts:
            begin = [i for i in range(len(t) - 99) if k != o and t[i : i + 100] in grams[o]]
            for i in begin:
                if i - 1 not in begin:
                    n = next(n for n in range(1, len(t)) if i + n not in begin)
                    want.add((k, o, i, n + 99))
    assert {tuple(r) for r in spans.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
    assert spans.passages(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).collect() == []


def test_periodic_texts_take_linear_work():
    n = 200_000
    began = time.time()
    assert spans.common_passages("-" * n, "-" * (n + 5), 100) == ([(0, n)], [(0, n + 5)])
    assert spans.common_passages("ab" * n, "x" + "ba" * n, 100) == ([(0, 2 * n)], [(1, 2 * n)])
    assert spans.common_passages("ab-" * n, "x" + "ba" * n, 100) == ([], [])
    assert time.time() - began < 30


def test_buckets_are_folded_and_hot_anchors_spread(spark):
    """However small the stretches and the folded pieces are, each hot anchor keeps all its records."""
    r = random.Random(5)
    notice = "".join(r.choice("abcdefgh") for _ in range(130))
    rows = [(k, chr(0x4E00 + k) * 7 + notice[: 99 + k % 3] + chr(0x5E00 + k) * 9) for k in range(1, 170)] + [(k, notice[40:120] + chr(0x7000 + k)) for k in range(300, 310)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = {(k, len(t), 0 if k >= 300 or k % 3 == 0 else 99 + k % 3) for k, t in rows}
    assert {(x.doc_id, x.n_chars, x.shared_chars) for x in spans.shared_amount(df).collect()} == held
    assert {(x.doc_a, x.doc_b) for x in spans.span_pairs(df).collect()} == brute.span_pairs(rows)
    docs = df.selectExpr("doc_id AS rec", "text").coalesce(1)
    of = {}
    for k, t in rows:
        for h in spans.anchors([t], 100)[2].tolist():
            of.setdefault(h, set()).add(k)
    for paired in (1, spans.PAIRED):
        for most in (20, 400, 4_000_000):
            met = spans._meet(spans._blobs(docs, 100, 64, most), 64, paired, most).distinct().collect()
            got, pairs = {}, {(x.a, x.b) for x in met if x.b is not None}
            for x in met:
                if x.b is None:
                    got.setdefault(x.h, set()).add(x.a)
            assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in of.values() if len(v) > paired)
            assert pairs == {p for v in of.values() if paired >= len(v) > 1 for p in combinations(sorted(v), 2)}
