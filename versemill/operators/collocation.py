"""Collocation statistics: counts, smoothed log-probabilities and what is built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versemill.functions import tables as T
from versemill.functions import text as tx


def line_words(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(id, line_no, words): the words of each line, by line ends of any kind."""
    rows = df.select(F.col(key).alias("id"), F.posexplode(tx.any_lines(F.col(text))).alias("line_no", "line"))
    return rows.select("id", "line_no", tx.words(F.col("line")).alias("words"))


def bigrams(rows: DataFrame) -> DataFrame:
    """(id, line_no, at, left, right): neighbours within a line."""
    w = F.col("words")
    pairs = F.arrays_zip(F.slice(w, F.lit(1), F.size(w) - 1).alias("left"), F.slice(w, F.lit(2), F.size(w) - 1).alias("right"))
    return rows.where(F.size(w) >= 2).select("id", "line_no", F.posexplode(pairs).alias("at", "p")).select("id", "line_no", "at", "p.left", "p.right")


def counts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unigrams(word, n), bigrams(left, right, n))."""
    uni = rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return uni, bigrams(rows).groupBy("left", "right").agg(F.count("*").alias("n"))


def scored_bigrams(rows: DataFrame, uni: DataFrame, bi: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(id, line_no, at, left, right, n, lp) of every bigram; absent counts are 0.

    The probability of a bigram is worked out once for each distinct one, then joined.
    """
    vocabulary = uni.agg(F.greatest(F.lit(1), F.count("*")).alias("v"))
    own = bigrams(rows)
    kinds = own.select("left", "right").distinct()
    known = kinds.join(bi, ["left", "right"], "left").join(uni.select(F.col("word").alias("left"), F.col("n").alias("u")), "left", "left").join(F.broadcast(vocabulary))
    zero = F.lit(0).cast("long")
    n = F.coalesce("n", zero)
    lp = F.log((n + alpha) / (F.coalesce("u", zero) + alpha * F.col("v")))
    return own.join(known.select("left", "right", n.alias("n"), lp.alias("lp")), ["left", "right"])


def poem_scores(scored: DataFrame, rare_cutoff: int = 1) -> DataFrame:
    """(id, pairs, mean_lp, unseen, rare) of each poem with at least one bigram, rates to four places."""
    return scored.groupBy("id").agg(
        F.count("*").alias("pairs"),
        F.avg("lp").alias("raw"),
        F.bround(F.avg("lp"), 4).alias("mean_lp"),
        F.bround(F.avg((F.col("n") == 0).cast("double")), 4).alias("unseen"),
        F.bround(F.avg((F.col("n") <= rare_cutoff).cast("double")), 4).alias("rare"),
    )


def bounded(raw: Column) -> Column:
    """The score in [0, 1] of a mean log-probability; 0 for null."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw + 12.0) / 8.0)), F.lit(0.0))


def lowest(scored: DataFrame, k: int = 5) -> DataFrame:
    """(id, rank, left, right, n, lp): the k least expected bigrams of each poem, earlier ones first on ties."""
    w = Window.partitionBy("id").orderBy("n", F.round("lp", 9), "line_no", "at")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def report(scores: DataFrame, by: list[str]) -> DataFrame:
    """Means of the poems' rounded figures, rounded again."""
    four = lambda c: F.bround(F.avg(c), 4)
    return scores.groupBy(*by).agg(F.count("*").alias("n"), four("mean_lp").alias("mean_lp"), four("unseen").alias("unseen"), four("rare").alias("rare"))


def best_pairs(pool: DataFrame, most: float = 10.0) -> DataFrame:
    """(pool, high, low, gap): in each pool the two candidates of similar overall score whose mean
    log-probabilities lie farthest apart; the first in pool order on ties. Pools are small by nature."""
    a = pool.select("pool", F.col("idx").alias("high"), F.col("overall").alias("oa"), F.col("mean_lp").alias("la"))
    b = pool.select("pool", F.col("idx").alias("low"), F.col("overall").alias("ob"), F.col("mean_lp").alias("lb"))
    pairs = a.join(b, "pool").where((F.abs(F.col("oa") - F.col("ob")) <= most) & (F.col("la") > F.col("lb")))
    pairs = pairs.withColumn("gap", F.bround(F.col("la") - F.col("lb"), 4))
    w = Window.partitionBy("pool").orderBy(F.desc("gap"), "high", "low")
    return pairs.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("pool", "high", "low", "gap")


def clearest(pairs: DataFrame, count: int) -> DataFrame:
    """(pool, high, low, gap, place): the `count` pairs with the widest gaps, lower pools first on ties."""
    top = pairs.orderBy(F.desc("gap"), "pool").limit(count)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("gap"), "pool")).cast("long"))
