import os

import pytest

from versemill.llm import encode, mix

needs = pytest.mark.skipif(not os.path.exists(encode.VOCABULARY), reason="no vocabulary files here")
DOCS, TARGETS = "doc_id long, text string, source string", "source string, target_share double, max_repeats int"
TEXT = "từ nào cũng được "


@needs
def test_mix_is_as_large_as_the_corpus_with_documents_of_no_source(spark):
    docs = spark.createDataFrame([(k, TEXT * (3 + k % 5), None if k % 2 else "a") for k in range(1200)], DOCS)
    targets = spark.createDataFrame([("a", 1.0, 9)], TARGETS)
    corpus = sum(r.tokens for r in mix.document_tokens(docs).collect())
    (got,) = mix.mix_shares(docs, targets, block_tokens=1024).collect()
    assert abs(got.mixed_tokens / corpus - 1) < 0.1 and got.rounds >= 2


@needs
def test_rows_of_the_mix_are_the_documents_of_its_slots(spark):
    docs = spark.createDataFrame([(k, TEXT * (3 + k % 5), s) for k, s in enumerate(["a"] * 90 + ["B "] * 30 + [None] * 20)] + [(900, None, "a"), (901, "", "b")], DOCS)
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.6, 3)], TARGETS)
    rows = mix.mix(docs, targets, block_tokens=256).collect()
    size = {r.doc_id: r.tokens for r in mix.document_tokens(docs).collect()}
    of = {**{k: "a" for k in range(90)}, **{k: "b" for k in range(90, 120)}}
    assert rows and all(of[r.doc_id] == r.source for r in rows)
    assert max(r.round for r in rows if r.source == "a") == 0 and 0 < max(r.round for r in rows if r.source == "b") < 3
    parts, slots = {}, {}
    for r in rows:
        parts.setdefault((r.doc_id, r.round), set()).update(range(r.first_token, r.first_token + r.tokens))
        slots.setdefault((r.slot, r.round, r.source, r.block), []).append((r.at, r.tokens))
    assert all(t <= set(range(size[d])) for (d, _), t in parts.items())  # no token twice in a round
    assert sum(map(len, parts.values())) == sum(r.tokens for r in rows)
    planned = {(s.slot, s.round, s.source, s.block): s.tokens for s in mix.schedule(docs, targets, block_tokens=256).collect()}
    assert set(slots) == set(planned)
    for k, pieces in slots.items():  # the pieces fill the block without gaps
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end == planned[k] <= 256
    assert sum(n < 256 for n in {k[2:]: n for k, n in planned.items()}.values()) <= 2
    shares = {r.source: r.mixed_tokens for r in mix.mix_shares(docs, targets, block_tokens=256).collect()}
    assert shares == {s: sum(r.tokens for r in rows if r.source == s) for s in "ab"}


@needs
def test_size_of_the_mix_counts_every_source(spark, monkeypatch):
    monkeypatch.setattr(mix, "MOST_SOURCES", 2)
    docs = spark.createDataFrame([(k, TEXT * 5, f"s{k % 12}") for k in range(240)], DOCS)
    slots = mix.schedule(docs, spark.createDataFrame([("s0", 1.0, 99)], TARGETS), block_tokens=256)
    corpus = sum(r.tokens for r in mix.document_tokens(docs).collect())
    assert slots.count() == -(-corpus // 256)


@needs
def test_long_texts_go_over_equal_blocks(spark):
    docs = spark.createDataFrame([(1, TEXT * 2000, "a"), (2, TEXT, "a"), (2, TEXT, "a"), (3, TEXT * 700, "b")], DOCS)
    sized = mix.document_tokens(docs)
    held = {}
    for r in mix.blocks(sized, 256, 1).collect():
        held[r.source, r.block] = held.get((r.source, r.block), 0) + r.tokens
    for source in "ab":
        sizes = [n for (s, _), n in sorted(held.items()) if s == source]
        assert sizes[:-1] == [256] * (len(sizes) - 1) and 0 < sizes[-1] <= 256
        assert sum(sizes) == sized.where(f"source = '{source}'").groupBy().sum("tokens").first()[0]


@needs
def test_short_sources_as_by_counting(spark):
    """The schedule and the count agree, at the very edge of a share too, and two targets of one source add up."""
    docs = spark.createDataFrame([(k, TEXT * 4, f"s{k % 7}") for k in range(700)] + [(800, None, "s1"), (801, TEXT * 90, None)], DOCS)
    sums = {r.source: r.tokens for r in mix.document_tokens(docs).groupBy("source").sum("tokens").toDF("source", "tokens").collect()}
    total = sum(sums.values())
    edge = 2 * sums["s2"] / total
    rows = [("s1", 0.2, 1), (" S1", 0.02, 9), ("s2", edge, 2), ("s3", edge * (1 + 1e-6), 2), ("s4", 0.0, 1), ("s5", 0.1, None), ("no", 0.01, 5), (None, 0.1, 1), ("s6", 0.1, 3)]
    want = {s for s, share, n in rows if s and sums.get(s.strip().lower(), 0) * (n or 0) < share * total}
    for size in (16, 256, 4096):
        assert {r.source for r in mix.short_sources(docs, spark.createDataFrame(rows, TARGETS), block_tokens=size).collect()} == want
    assert {"s1", "s3", "s5", "no"} <= want


@needs
def test_too_many_targets_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mix, "MOST_SOURCES", 2)
    docs = spark.createDataFrame([(1, TEXT, "a")], DOCS)
    with pytest.raises(ValueError):
        mix.schedule(docs, spark.createDataFrame([(f"s{k}", 0.1, 1) for k in range(3)], TARGETS))
