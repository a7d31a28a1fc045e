"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versemill.llm.encode import VOCABULARY, token_counts
from versemill.plans.lineage import cut

#: The fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
#: Targets are a table of sources, not of data; more rows than this are refused.
MOST_SOURCES = 10_000
#: Rows of one source that a window holds at most, on average.
BUCKET_ROWS = 100_000


def plain_source(source: Column) -> Column:
    """A source without differences of case, blanks around, and hyphens for underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[\s\p{Z}_\-]+", "_")


def _targets(targets: DataFrame) -> list:
    """(plain, share, repeats) of each plain source with a share; rows of one plain source add up."""
    kept = targets.where("source IS NOT NULL AND target_share > 0").groupBy(plain_source(F.col("source")).alias("plain"))
    rows = kept.agg(F.sum("target_share").cast("double").alias("share"), F.coalesce(F.max("max_repeats"), F.lit(0)).cast("long").alias("repeats")).orderBy("plain").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return rows


def _running(df: DataFrame, group: str, bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """`df` with the sum of `value` over all earlier rows of its group as `name`.

    Sums of the buckets come first, so that a window never holds more than one bucket of a group.
    """
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(group, bucket, F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum(value).over(Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.join(sums, [group, bucket]).withColumn(name, F.col("_before") + F.coalesce(within, F.lit(0))).drop("_before")


def document_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of every document by plain source, those without a source (null) included."""
    return cut(token_counts(docs.select("doc_id", plain_source(F.col("source")).alias("source"), "text"), ["doc_id", "source"], path=path), "sized")


def blocks(sized: DataFrame, block_tokens: int, seed: int) -> DataFrame:
    """(source, block, at, doc_id, first_token, tokens): the tokens of each source in one sequence, the documents in
    shuffled order, cut into blocks of exactly `block_tokens` (the last one of a source may be shorter).

    A row is the part of a document, `tokens` from `first_token` on, that stands in the block from `at` on; a
    text may go over several blocks. The order is the hash of seed and key, the same on any cluster.
    Documents without a source or without tokens belong to no block.
    """
    shuffled = sized.where("tokens > 0 AND source IS NOT NULL").withColumn("hash", F.xxhash64(F.lit(seed), "doc_id"))
    bits = max(10, (sized.count() // BUCKET_ROWS).bit_length())
    shuffled = shuffled.withColumn("bucket", F.shiftrightunsigned("hash", 64 - bits)).withColumn("hash", F.expr("shiftrightunsigned(hash, 1)"))
    placed = _running(shuffled, "source", "bucket", ["hash", "doc_id"], F.col("tokens"), "before")
    ends = F.col("before") + F.col("tokens")
    cut_up = placed.withColumn("block", F.explode(F.sequence(F.expr(f"before DIV {block_tokens}"), F.expr(f"(before + tokens - 1) DIV {block_tokens}"))))
    begin = F.greatest("before", F.col("block") * block_tokens)
    end = F.least(ends, (F.col("block") + 1) * block_tokens)
    return cut_up.select("source", "block", (begin - F.col("block") * block_tokens).alias("at"), "doc_id", (begin - F.col("before")).alias("first_token"), (end - begin).alias("tokens"))


def _slots(spark, named: list, size: int, block_tokens: int) -> DataFrame:
    """(slot, source) of every slot of a mix of `size` tokens.

    Slot t goes to the source in whose part of the cumulated shares the point frac((t + 1/2) * golden
    ratio) falls, so every stretch of the schedule is close to the shares.
    """
    weight, bound, choice = sum(r["share"] for r in named), 0.0, None
    point = (F.col("id") + 0.5) * GOLDEN
    point = point - F.floor(point)
    for r in named[:-1]:
        bound += r["share"] / weight
        choice = F.when(point < bound, r["plain"]) if choice is None else choice.when(point < bound, r["plain"])
    last = F.lit(named[-1]["plain"] if named else None).cast("string")
    return spark.range(-(-size // block_tokens)).select(F.col("id").alias("slot"), (last if choice is None else choice.otherwise(last)).alias("source"))


def _held(sized: DataFrame) -> tuple[DataFrame, int]:
    """(source, held): the tokens of each plain source, null included; and those of all documents."""
    sums = cut(sized.groupBy("source").agg(F.sum("tokens").alias("held")), "sources")
    return sums, sums.agg(F.sum("held")).first()[0] or 0


def short_sources(docs: DataFrame, targets: DataFrame, block_tokens: int = 4096, path: str = VOCABULARY) -> DataFrame:
    """(source): the targets that can't be reached although every document is taken max_repeats times.

    The mix is as large as the corpus, documents of other sources or none included. The schedule gives
    each source its slots; a source whose blocks, taken max_repeats times, do not fill them (or fill them by
    less than the points of the schedule can stray from the shares) gets an exact count of tokens. A
    target without documents has 0 tokens; a null max_repeats allows none; targets keep their own spelling.
    """
    named = _targets(targets)
    sums, size = _held(document_tokens(docs, path))
    wanted = _slots(docs.sparkSession, named, size, block_tokens).groupBy(F.col("source").alias("plain")).agg(F.count("*").alias("slots"))
    # N points of the golden ratio's multiples stray from an interval's share by less than 2 (3 + 2.1 ln N)
    astray = 2 * (3 + 2.1 * math.log(max(2, size // block_tokens)))
    weight = max(1.0, sum(r["share"] for r in named))
    rows = targets.where("source IS NOT NULL AND target_share > 0").select("source", plain_source(F.col("source")).alias("plain"), "target_share", F.coalesce("max_repeats", F.lit(0)).cast("long").alias("repeats"))
    rows = rows.join(wanted, "plain", "left").join(sums.select(F.col("source").alias("plain"), "held"), "plain", "left").na.fill(0, ["slots", "held"])
    near = rows.where(F.ceil(F.col("held") / block_tokens) * F.col("repeats") <= (F.col("slots") + astray) * weight + F.col("repeats"))
    return near.where(F.col("held") * F.col("repeats") < F.col("target_share") * F.lit(size)).select("source").distinct()


def schedule(docs: DataFrame, targets: DataFrame, block_tokens: int = 4096, seed: int = 1, path: str = VOCABULARY) -> DataFrame:
    """(slot, source, block, round, tokens): the blocks of the mix, in order; mix() has their documents."""
    return _scheduled(document_tokens(docs, path), targets, block_tokens)


def mix(docs: DataFrame, targets: DataFrame, block_tokens: int = 4096, seed: int = 1, path: str = VOCABULARY) -> DataFrame:
    """(slot, round, source, block, at, doc_id, first_token, tokens): the parts of documents in the mix, whose order is
    that of slot and at; a document stands once in each round in which its blocks are taken."""
    sized = document_tokens(docs, path)
    slots = _scheduled(sized, targets, block_tokens)
    return slots.drop("tokens").join(blocks(sized, block_tokens, seed), ["source", "block"]).select("slot", "round", "source", "block", "at", "doc_id", "first_token", "tokens")


def _scheduled(sized: DataFrame, targets: DataFrame, block_tokens: int) -> DataFrame:
    """(slot, source, block, round, tokens).

    The k-th slot of a source takes its k-th block, in the first round or in a repetition; slots beyond
    max_repeats rounds stay empty and are left out. Null and empty texts take no part; the mix is as
    large as the corpus, documents of other sources or none included.
    """
    spark = sized.sparkSession
    named = _targets(targets)
    sums, size = _held(sized)
    slots = _slots(spark, named, size, block_tokens).withColumn("bucket", F.shiftright("slot", 16))
    slots = _running(slots, "source", "bucket", ["slot"], F.lit(1), "k")
    repeats = spark.createDataFrame([(r["plain"], r["repeats"]) for r in named], "source string, repeats long")
    whole = sums.where("held > 0").join(F.broadcast(repeats), "source").withColumn("n", F.ceil(F.col("held") / block_tokens))
    taken = slots.join(whole, "source").withColumn("round", F.expr("k DIV n")).where("round < repeats").withColumn("block", F.col("k") % F.col("n"))
    return taken.select("slot", "source", "block", "round", F.least(F.lit(block_tokens).cast("long"), F.col("held") - F.col("block") * block_tokens).alias("tokens"))


def mix_shares(docs: DataFrame, targets: DataFrame, block_tokens: int = 4096, seed: int = 1, path: str = VOCABULARY) -> DataFrame:
    """(source, target_share, mixed_tokens, rounds, actual_share) of every target; 0 where nothing is mixed.

    Targets of one plain source each show what that source has in the mix.
    """
    sums = mix(docs, targets, block_tokens, seed, path).groupBy(F.col("source").alias("plain")).agg(F.sum("tokens").alias("mixed_tokens"), (F.max("round") + 1).alias("rounds"))
    sums = cut(sums, "mixed")
    total = sums.agg(F.sum("mixed_tokens").alias("total"))
    named = targets.where("source IS NOT NULL").withColumn("plain", plain_source(F.col("source")))
    out = named.join(sums, "plain", "left").join(F.broadcast(total))
    none = F.lit(0).cast("long")
    mixed_tokens = F.coalesce("mixed_tokens", none)
    share = F.coalesce(F.try_divide(mixed_tokens.cast("double"), F.col("total")), F.lit(0.0))
    return out.select("source", "target_share", mixed_tokens.alias("mixed_tokens"), F.coalesce("rounds", none).alias("rounds"), F.round(share, 6).alias("actual_share"))
