"""Distinct word multisets of a table, and their shards for exact similarity search.

`classes` reads the texts once and folds rows with equal word multisets into one class. `shards`
gives each class a row in every shard in which a partner of it can be: with the words of a text in
one fixed order, rarest first, two near-duplicates share a word among the first
n - needed(n) + 1 of each. A shard with more than `limit` rows is parted by a second word, which
near-duplicates share as well; what is still larger is held block against block, so that no task
ever gets an unbounded group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.llm import fingerprints as fp
from versemill.plans.lineage import cut

LIMIT = 20_000
#: The most terms whose frequencies are told apart (16 bytes each); all rarer ones count as equally rare.
MOST_RANKED = 500_000


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def terms_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(rec, s1, s2, n, terms) of the rows that take part; rows with a null key are left out.

    Texts of fewer than ten words, null and empty ones among them, take no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, terms = fp.term_arrays(batch.column(1))
            n = np.diff(offsets)
            s1, s2 = fp.signatures(offsets, terms)
            all_rows = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(n.astype(np.int32)), _lists(offsets, terms)],
                ["rec", "s1", "s2", "n", "terms"],
            )
            yield all_rows.filter(pa.array(n >= fp.MIN_WORDS))

    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("rec"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "rec long, s1 long, s2 long, n int, terms array<long>")


def classes(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members(rec, rep), reps(rec, n, terms)): rows of equal multisets, and their row of least key."""
    rows = cut(terms_table(df, key, text), "terms")
    first = rows.groupBy("s1", "s2").agg(F.min("rec").alias("rep"))
    members = cut(rows.select("rec", "s1", "s2").join(first, ["s1", "s2"]), "members")
    others = members.where("rec <> rep").select("rec", "s1", "s2")
    reps = rows.join(others, ["rec", "s1", "s2"], "left_anti").select("rec", "n", "terms")
    return members.select("rec", "rep"), cut(reps, "classes")


def common_terms(reps: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(terms ascending, counts) of the terms in more than one of MOST_RANKED of all places.

    So there are fewer than MOST_RANKED of them, whatever the size of the table. Other terms count as
    equally rare, so they only decide the order of words.
    """
    places = reps.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    found = reps.select(F.explode("terms").alias("t")).groupBy("t").count().where(F.col("count") > places / MOST_RANKED).toPandas()
    order = np.argsort(found["t"].to_numpy().astype(np.int64).view(np.uint64))
    return found["t"].to_numpy().astype(np.int64).view(np.uint64)[order], found["count"].to_numpy()[order]


def ranked(offsets: np.ndarray, terms: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The terms of each row with the rarest first, and their places in the row."""
    names, counts = common
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    rank = np.zeros(len(terms), np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, terms), len(names) - 1)
        rank = np.where(names[at] == terms, counts[at], 0)
    order = np.lexsort((terms, rank, row))
    return terms[order], np.arange(len(terms)) - offsets[:-1][row]


def _columns(batch: pa.RecordBatch, name: str = "terms") -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(batch.schema.get_field_index(name))
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return offsets, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


_ENTRY = "shard long, rec long, n int, spent int, low long, high long"
#: As an extra column: the words after the shard's, see fingerprints.Balls.
TAIL = "tail"


def _tails(at: np.ndarray, end: np.ndarray, short: np.ndarray) -> pa.Array:
    """The short hashes of the places after `at` and before `end`; null where they are more than TAIL."""
    held = short.tobytes()
    return pa.array([held[2 * a + 2 : 2 * e] if e - a - 1 <= fp.Balls.TAIL else None for a, e in zip(at.tolist(), end.tolist())], pa.binary())


def _entries(reps: DataFrame, common, words: int, extra: list[str]) -> DataFrame:
    """A row for each class and each of its shards, by one word or by two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, terms = _columns(batch)
            n = np.diff(offsets)
            terms, place = ranked(offsets, terms, common)
            short = fp.short_hashes(terms)
            flipped = fp.prefix_parities(short)
            row = np.repeat(np.arange(len(n)), n)
            last = n - fp.needed(n) + words  # places from here on are never the shard's
            at = np.flatnonzero(place < last[row])
            if words == 1:
                shard, of = terms[at], row[at]
            else:
                parent = batch.column(batch.schema.get_field_index("parent")).to_numpy().view(np.uint64)
                begin = np.zeros(len(n), np.int64)
                hit = terms[at] == parent[row[at]]
                begin[row[at][hit]] = place[at][hit]
                after = place[at] > begin[row[at]]
                at = at[after]
                of = row[at]
                shard = fp.mix(parent[of] ^ fp.mix(terms[at]))
            take = pa.array(of)
            made = {TAIL: _tails(at, offsets[:-1][of] + last[of] + fp.Balls.DEPTH, short)} if TAIL in extra else {}
            low, high = ((f[offsets[1:][of]] ^ f[at + 1]).view(np.int64) for f in flipped)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.view(np.int64)), batch.column(0).take(take), pa.array(n[of].astype(np.int32)), pa.array((place[at] - words + 1).astype(np.int32)), pa.array(low), pa.array(high)]
                + [made[x] if x in made else batch.column(batch.schema.get_field_index(x)).take(take) for x in extra],
                ["shard", "rec", "n", "spent", "low", "high", *extra],
            )

    schema = _ENTRY + "".join(f", {x} {'binary' if x == TAIL else reps.schema[x].dataType.simpleString()}" for x in extra)
    return reps.mapInArrow(run, schema)


def shards(reps: DataFrame, common, limit: int = LIMIT, extra: list[str] = []) -> DataFrame:
    """Rows (shard, i, j, own, rec, n, spent, low, high, *extra) of all shards.

    `spent` is the number of words of the row before the last word of the shard that are not the shard's,
    and `low` and `high` are the fingerprint of the words after it.

    A small shard has i = j = 0. A large one is cut into blocks; its part (i, j) holds the rows of
    blocks i and j, `own` being the block of the row: rows of one part are to be compared if i = j
    or their blocks differ.
    """
    kept = ["rec", "terms", *[x for x in extra if x != TAIL]]
    one = _entries(reps.select(*kept), common, 1, extra)
    none = [F.lit(0).alias(x) for x in ("i", "j", "own")]
    small = lambda d: d.select("shard", *none, "rec", "n", "spent", "low", "high", *extra)
    large = cut(one.groupBy("shard").count().where(F.col("count") > limit), "large")
    if large.isEmpty():
        return small(one)
    parted = one.join(large, "shard", "left_semi").select("rec", F.col("shard").alias("parent"))
    two = _entries(reps.select(*kept).join(parted, "rec"), common, 2, extra)
    huge = cut(two.groupBy("shard").count().where(F.col("count") > limit), "huge")
    blocks = F.ceil(F.col("count") / limit).cast("int")
    own = F.pmod(F.xxhash64("rec"), blocks).cast("int")
    part = (
        two.join(huge, "shard")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rec", "n", "spent", "low", "high", *extra)
    )
    return small(one.join(large, "shard", "left_anti")).union(small(two.join(huge, "shard", "left_anti"))).union(part)


def by_shard(entries: DataFrame, work: Callable[[dict[str, np.ndarray]], Iterator[tuple]], schema: str) -> DataFrame:
    """Runs `work` on the columns of each part of each shard, one part in memory at a time.

    `work` yields tuples of arrays, one array for each column of `schema`.
    """
    names = entries.columns
    types = [f.split()[1] for f in schema.split(",")]
    kinds = {"long": np.int64, "int": np.int32, "double": np.float64}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def out() -> Iterator[tuple]:
            if held:
                yield from work({k: np.concatenate([h[k] for h in held]) for k in names})

        def packed(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            buffer, size = [], 0
            for row in rows:
                if len(row[0]):
                    buffer.append(row)
                    size += len(row[0])
                if size > 100_000:
                    yield pack(buffer)
                    buffer, size = [], 0
            if buffer:
                yield pack(buffer)

        def pack(buffer: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array(np.concatenate([b[k] for b in buffer]).astype(kinds[t])) for k, t in enumerate(types)]
            return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in schema.split(",")])

        def all_rows() -> Iterator[tuple]:
            for batch in batches:
                c = {k: batch.column(m).to_numpy(zero_copy_only=False) for m, k in enumerate(names)}
                change = np.flatnonzero((np.diff(c["shard"]) != 0) | (np.diff(c["i"]) != 0) | (np.diff(c["j"]) != 0)) + 1
                for s, e in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                    piece = {k: v[s:e] for k, v in c.items()}
                    if held and e > s and any(held[-1][k][0] != piece[k][0] for k in ("shard", "i", "j")):
                        yield from out()
                        held.clear()
                    if e > s:
                        held.append(piece)
            yield from out()
            held.clear()

        yield from packed(all_rows())

    return entries.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j").mapInArrow(run, schema)
