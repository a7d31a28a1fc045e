"""Same or near-same records across splits: a cosine join.

A text is a vector over its terms (the k-th occurrence of a word is a term of its own), scaled to
length one. Near-duplicates are defined by counts, so the terms of one text weigh the same, n ** -0.5 each; any
other weights (by rarity, say) would need a lower threshold to lose no pair, and would prune less.
Near-duplicates have common >= 0.7 * max(n, m), hence a cosine common / sqrt(n * m) of at least 0.7.

Only the rarest terms of a vector enter the inverted lists: the others are left out as long as they
alone can't reach the threshold with any vector. A partner that reaches it has at least 0.7 n terms, so
its weights are at most (0.7 n) ** -0.5 (maximum weight), and the left-out terms times that weight stay
below it. Within a list a pair is left if the product of the matched weights and of the norms of what
follows in both vectors (residual norms) can't reach the threshold; at the first term that a pair has
in common that bound is sound, so no pair is lost. Then pairs go whose fingerprints show that the dot
product is too small. What remains gets its exact dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.llm import fingerprints as fp
from versemill.llm import shards as sh
from versemill.llm.near_duplicates import exact_overlap
from versemill.llm.split_groups import split_name
from versemill.plans.lineage import cut

TRAIN, EVAL = 1, 2
#: Pairs whose fingerprints are compared at once.
ROWS = 2_000_000


def residual_bound(n, m, i, k):
    """The greatest dot product of unit vectors of n and m equal weights of whose terms i and k follow the
    first common one: the matched weights, and the product of the residual norms."""
    return (1 + np.sqrt(i * k)) / np.sqrt(n * m)


def least_residual(n: int, i: int) -> float:
    """The least number of following terms with which any vector can reach the threshold with one of n
    terms, i of which follow."""
    need = fp.SHARE / 10 * n - 1
    return need * need / i - 1e-6 if i else (0.0 if need <= 1e-6 else np.inf)


class _List:
    """One inverted list: its train and evaluation rows, and how many pairs each bound leaves."""

    def __init__(self, c: dict[str, np.ndarray]):
        self.c = c
        self.train, self.held = np.flatnonzero(c["sides"] & TRAIN), np.flatnonzero(c["sides"] & EVAL)
        self.every, self.bounded, self.near = self.train.size * self.held.size, 0, 0

    def pairs(self) -> Iterator[tuple]:
        """(train rec, evaluation rec) of the pairs that can reach the threshold: by the norms first, and only of those
        that are left by the fingerprints of what follows."""
        c, train, held = self.c, self.train, self.held
        if not train.size or not held.size:
            return
        blocks = c["i"][0] != c["j"][0]
        n, spent, low, high = c["n"].astype(np.int64), c["spent"].astype(np.int64), c["low"].view(np.uint64), c["high"].view(np.uint64)
        follows = n - spent - 1  # terms that follow the matched one: n times the square of the residual norm
        held = held[np.argsort(-follows[held], kind="stable")]
        # train rows with one count and place have one norm and one residual norm, so one bound for all
        order = train[np.lexsort((spent[train], n[train]))]
        cuts = np.flatnonzero((np.diff(n[order]) != 0) | (np.diff(spent[order]) != 0)) + 1
        for x in np.split(order, cuts):
            size, rest = int(n[x[0]]), int(follows[x[0]])
            # the others must leave a residual norm that lets the dot product reach the threshold
            some = held[: np.searchsorted(-follows[held], -least_residual(size, rest), side="right")]
            can = residual_bound(size, n[some], rest, follows[some]) >= fp.SHARE / 10 * np.maximum(size, n[some]) / np.sqrt(size * n[some]) - 1e-9
            some = some[can]
            if not some.size:
                continue
            self.bounded += x.size * some.size
            far = fp.farthest(np.int64(size), n[some]) - spent[some]
            step = max(1, ROWS // some.size)
            for s in range(0, x.size, step):
                t = x[s : s + step]
                d = np.bitwise_count(low[t][:, None] ^ low[some][None, :])
                d += np.bitwise_count(high[t][:, None] ^ high[some][None, :])
                a, b = np.nonzero(d <= (far[None, :] - spent[t][:, None]))
                p, q = t[a], some[b]
                ok = c["rec"][p] != c["rec"][q]
                if blocks:
                    ok &= c["own"][p] != c["own"][q]
                self.near += int(ok.sum())
                yield c["rec"][p[ok]], c["rec"][q[ok]]


def _lists(c: dict[str, np.ndarray]) -> Iterator[tuple]:
    return _List(c).pairs()


def _effort(c: dict[str, np.ndarray]) -> Iterator[tuple]:
    one = _List(c)
    for _ in one.pairs():
        pass
    yield tuple(np.array([v]) for v in (c["shard"][0], one.every, one.bounded, one.near))


def _inverted(df: DataFrame, key: str, text: str, split: str, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members(rec, rep, side), reps, entries of the inverted lists)."""
    name = split_name(F.col(split))
    side = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("rec"), F.when(name == "train", TRAIN).when(name.isin("dev", "test"), EVAL).alias("side"))
    known = df.withColumn(split, name).where(F.col(split).isNotNull())
    members, reps = sh.classes(known, key, text)
    members = cut(members.join(side.where("side IS NOT NULL"), "rec").distinct(), "sided")
    reps = reps.join(members.groupBy(F.col("rep").alias("rec")).agg(F.bit_or("side").alias("sides")), "rec")
    common = sh.common_terms(reps)
    return members, reps, sh.shards(reps, common, limit, ["sides"])


def join_effort(df: DataFrame, key: str = "rec_no", text: str = "text", split: str = "split", limit: int = sh.LIMIT) -> DataFrame:
    """(shard, pairs, bounded, near) of each inverted list: its pairs of both sides, those that the norms leave, and those
    of them that the fingerprints leave for the exact dot product."""
    return sh.by_shard(_inverted(df, key, text, split, limit)[2], _effort, "shard long, pairs long, bounded long, near long")


def split_classes(df: DataFrame, key: str, text: str, split: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(members(rec, rep, side), links(a, b)): rows with their side, and pairs of classes of different
    texts, a held in train and b in an evaluation split, that are near-duplicates."""
    members, reps, entries = _inverted(df, key, text, split, limit)
    found = sh.by_shard(entries, _lists, "a long, b long").distinct()
    near = exact_overlap(found, reps).where(F.col("common") * 10 >= F.greatest("na", "nb") * fp.SHARE)
    return members, cut(near.select("a", "b"), "links")


def cross_split_pairs(df: DataFrame, key: str = "rec_no", text: str = "text", split: str = "split", limit: int = sh.LIMIT) -> DataFrame:
    """(rec_a, rec_b), rec_a < rec_b: one record in train, the other in dev or test, near-duplicates.

    Splits count whatever their spelling; rows of none of the three, without a key or with fewer than
    ten words (null and empty texts too) take no part. Rows of equal words are joined as one class
    and expanded at the end, as every pair of records is asked for.
    """
    members, links = split_classes(df, key, text, split, limit)
    train = members.where(f"side = {TRAIN}").select("rep", F.col("rec").alias("x"))
    held = members.where(f"side = {EVAL}").select("rep", F.col("rec").alias("y"))
    copies = train.join(held, "rep").select("x", "y")
    near = links.join(train.withColumnRenamed("rep", "a"), "a").join(held.withColumnRenamed("rep", "b"), "b").select("x", "y")
    return copies.union(near).where("x <> y").select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b")).distinct()


def overlap_report(df: DataFrame, key: str = "rec_no", text: str = "text", split: str = "split", source: str = "source_id") -> DataFrame:
    """(split, source, records, overlapping): per evaluation split and source, how many records there
    are and how many of them have a near-duplicate in train. Sources as stored, null included."""
    members, links = split_classes(df, key, text, split, sh.LIMIT)
    hit = links.select(F.col("b").alias("rep")).union(members.where(f"side = {TRAIN}").select("rep")).distinct()
    hit = members.where(f"side = {EVAL}").join(hit, "rep", "left_semi").select(F.col("rec").alias(key)).distinct().withColumn("hit", F.lit(1))
    rows = df.select(key, split_name(F.col(split)).alias("split"), F.col(source).alias("source")).where("split IN ('dev', 'test')")
    return rows.join(hit, key, "left").groupBy("split", "source").agg(F.count("*").alias("records"), F.count("hit").alias("overlapping"))
