"""Near-duplicate records with small edits: groups by vantage-point trees over fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.llm import fingerprints as fp
from versemill.llm import shards as sh
from versemill.operators.components import connected_components
from versemill.plans.lineage import cut


def _balls(c: dict[str, np.ndarray]) -> fp.Balls:
    return fp.Balls(c["low"].view(np.uint64), c["high"].view(np.uint64), c["n"], c["spent"], list(c[sh.TAIL]))


def search_effort(df: DataFrame, key: str = "rec_no", text: str = "text", limit: int = sh.LIMIT) -> DataFrame:
    """(shard, records, pairs, compared, splits) of each part of a shard: how many pairs it has, how many
    of them the tree compares, and how many nodes are parted."""

    def work(c: dict[str, np.ndarray]) -> Iterator[tuple]:
        balls, size = _balls(c), len(c["rec"])
        if c["i"][0] == c["j"][0]:
            every = size * (size - 1) // 2
            for _ in balls.pairs(np.arange(size)):
                pass
        else:
            left = int((c["own"] == c["i"][0]).sum())
            every = balls.compared = left * (size - left)
        yield tuple(np.array([v]) for v in (c["shard"][0], size, every, balls.compared, balls.splits))

    _, reps = sh.classes(df, key, text)
    entries = sh.shards(reps, sh.common_terms(reps), limit, [sh.TAIL])
    return sh.by_shard(entries, work, "shard long, records long, pairs long, compared long, splits long")


def _candidates(every: bool):
    """The work on one part of a shard: a spanning forest of its candidate pairs, or all of them
    that lie between different groups (label)."""

    def work(c: dict[str, np.ndarray]) -> Iterator[tuple]:
        if len(c["rec"]) < 2 or every and (c["label"] == c["label"][0]).all():
            return
        balls = _balls(c)
        blocks = c["i"][0] != c["j"][0]
        if blocks:
            pairs = balls.pairs_across(np.flatnonzero(c["own"] == c["i"][0]), np.flatnonzero(c["own"] == c["j"][0]))
        else:
            pairs = balls.pairs(np.arange(len(c["rec"])))
        rec, shard = c["rec"], c["shard"][0]
        if every:
            for x, y in pairs:
                apart = c["label"][x] != c["label"][y]
                x, y = rec[x[apart]], rec[y[apart]]
                yield np.minimum(x, y), np.maximum(x, y), np.full(len(x), shard)
            return

        def near(p: int, left: np.ndarray) -> np.ndarray:
            ok = balls.met(p, left)
            return ok & (c["own"][left] != c["own"][p]) if blocks else ok

        a, b = fp.forest(len(rec), pairs, neighbours=near)
        a, b = rec[a], rec[b]
        yield np.minimum(a, b), np.maximum(a, b), np.full(len(a), shard)

    return work


def exact_overlap(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """`pairs` (a, b) with `common`, the words both have, and the word counts na and nb."""
    left = reps.select(F.col("rec").alias("a"), F.col("n").alias("na"), F.col("terms").alias("ta"))
    right = reps.select(F.col("rec").alias("b"), F.col("n").alias("nb"), F.col("terms").alias("tb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.withColumn("common", F.size(F.array_intersect("ta", "tb"))).drop("ta", "tb")


def near_duplicate_groups(df: DataFrame, key: str = "rec_no", text: str = "text", limit: int = sh.LIMIT) -> DataFrame:
    """(key, group_no) for every record of a group of two or more near-duplicates.

    Records are near-duplicates if the words in common, counted with repetition, are at least 70 %
    of the words of the longer one; a group is all that is linked directly or through others, and
    its number is its least key. Records of fewer than ten words (null and empty texts too) take
    no part; records with equal words are one class, so copies are never compared. Repeated rows
    change nothing; a key with several texts is linked through each of them. Rows without a key are
    left out, an empty table gives no rows, and other columns are not read.

    Each shard is searched by a vantage-point tree over parity fingerprints and gives a spanning
    forest of its candidate pairs, which are then counted exactly. Where a pair of a forest turns out
    not to be a link, its shards are searched again for all pairs between different groups; every
    other candidate has both ends in one group already. So no link is lost, and a large group costs
    one pair a member and shard instead of all its pairs.
    """
    members, reps = sh.classes(df, key, text)
    common = sh.common_terms(reps)
    entries = sh.shards(reps, common, limit, [sh.TAIL])
    found = cut(sh.by_shard(entries, _candidates(False), "a long, b long, shard long"), "candidates")
    checked = cut(exact_overlap(found.select("a", "b").distinct(), reps).select("a", "b", (F.col("common") * 10 >= F.greatest("na", "nb") * fp.SHARE).alias("ok")), "checked")
    links = checked.where("ok").select("a", "b")
    again = cut(found.join(checked.where("NOT ok"), ["a", "b"], "left_semi").select("shard").distinct(), "again")
    if not again.isEmpty():
        label = cut(connected_components(links, "a", "b"), "labels").select(F.col("node").alias("rec"), "component")
        labelled = reps.join(label, "rec", "left").select("rec", "n", "terms", F.coalesce("component", "rec").alias("label"))
        part = sh.shards(labelled, common, limit, ["label", sh.TAIL]).join(again, "shard", "left_semi")
        more = cut(sh.by_shard(part, _candidates(True), "a long, b long, shard long").select("a", "b").distinct(), "more")
        more = more.join(checked.where("NOT ok").select("a", "b"), ["a", "b"], "left_anti")
        links = links.union(exact_overlap(more, reps).where(F.col("common") * 10 >= F.greatest("na", "nb") * fp.SHARE).select("a", "b"))
    copies = members.where("rec <> rep").select(F.col("rec").alias("a"), F.col("rep").alias("b"))
    whole = connected_components(links.union(copies), "a", "b")
    return whole.select(F.col("node").alias(key), F.col("component").alias("group_no"))
