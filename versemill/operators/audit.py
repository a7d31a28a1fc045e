"""Ratings, tallies and review imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.functions import tables as T
from versemill.functions import text as tx
from versemill.operators.agent import clean_keywords

TONES = ["Chân thành", "Hài hước"]
GENERAL = ["mọi nhà", "mọi người"]


def audit_summary(df: DataFrame, natural: str, imagery: str, sensitive: str, decision: str, gate: float = 0.8, strict: bool = True) -> DataFrame:
    """One row: counts, acceptance rate, means, and whether the share of accepted records passes the gate.

    A rating that is no number of its domain, or a decision that is none, fails the job; with `strict` off such
    rows are counted as `invalid`, take no part in anything else, and the gate is not passed.
    """
    n, i = F.expr(f"try_cast({natural} AS INT)"), F.expr(f"try_cast({imagery} AS INT)")
    s = F.expr(f"try_cast({sensitive} AS INT)")
    d = F.lower(tx.strip(F.col(decision)))
    ok = F.coalesce(n.between(1, 5) & i.between(1, 5) & s.isin(0, 1) & d.isin("accept", "reject"), F.lit(False))
    if strict:
        ok = F.when(ok, True).otherwise(F.raise_error(F.lit("a rating is outside its domain")).cast("boolean"))
    rows = df.select(n.alias("n"), i.alias("i"), s.alias("s"), d.alias("d"), ok.alias("ok"))
    of = lambda c: F.coalesce(F.sum(F.when(F.col("ok") & c, 1).otherwise(0)), F.lit(0).cast("long"))
    mean = lambda c: F.bround(F.avg(F.when(F.col("ok"), F.col(c))), 3)
    rated, accepted = of(F.lit(True)), of(F.col("d") == "accept")
    rate = F.coalesce(F.try_divide(accepted.cast("double"), rated), F.lit(0.0))
    return rows.agg(
        F.count("*").alias("n"), rated.alias("rated"), (F.count("*") - rated).alias("invalid"), accepted.alias("accepted"), (rated - accepted).alias("rejected"), F.bround(rate, 4).alias("accept_rate"),
        mean("n").alias("naturalness"), mean("i").alias("imagery"), of(F.col("s") == 1).alias("sensitive"), ((rate >= gate) & (F.count("*") == rated)).alias("gate_passed"),
    )


def choice(value: Column) -> Column:
    """A, B or TIE from a reviewer's note; null for notes that say none of these."""
    v = F.upper(tx.strip(value))
    return F.when(v.isin("A", "B", "TIE"), v).when(v.rlike("^A[^A-Z0-9]"), "A").when(v.rlike("^B[^A-Z0-9]"), "B")


def paired_tally(ratings: DataFrame, key: DataFrame, pair: str = "pair_id") -> DataFrame:
    """(winner, n): ratings decoded by the blind key. Fails the job unless both hold the same pairs."""
    both = ratings.select(pair, F.lit(True).alias("_r"), "preference").join(key.select(pair, F.lit(True).alias("_k"), "a_is", "b_is"), pair, "full_outer")
    whole = F.when(F.col("_r").isNull() | F.col("_k").isNull(), F.raise_error(F.lit("ratings and key hold different pairs")).cast("string"))
    winner = F.when(F.col("preference") == "A", F.col("a_is")).when(F.col("preference") == "B", F.col("b_is")).otherwise("tie")
    return both.select(F.coalesce(whole, winner).alias("winner")).groupBy("winner").agg(F.count("*").alias("n"))


def agreement(df: DataFrame, human: Column, a: Column, b: Column) -> DataFrame:
    """One row: how often a human's choice is the side with the higher score; equal scores count as B."""
    rows = df.select(human.alias("h"), F.when(a > b, "A").otherwise("B").alias("m")).where(F.col("h").isin("A", "B"))
    return rows.agg(F.count("*").alias("n"), F.bround(F.coalesce(F.avg((F.col("h") == F.col("m")).cast("double")), F.lit(0.0)), 4).alias("agreement"))


def gold_import(df: DataFrame, order: str) -> DataFrame:
    """`df` with `reject_reason` (the first that applies, null for accepted rows), `poem_clean`, `text_sha256`,
    `recipient_scope`.

    Reviewed rows need a recipient, two or three different keywords, an allowed tone and a poem; of equal
    poems among those that pass, the first in order stays.
    """
    field = lambda c: F.regexp_replace(tx.strip(tx.nfc(F.coalesce(F.col(c), F.lit("")))), "[ \t]+", " ")
    lines = F.split(tx.nfc(F.coalesce("poem", F.lit(""))), "\r\n|\r|\n")
    cleaned = F.transform(lines, lambda x: tx.strip(F.regexp_replace(F.translate(x, "()\"“”*", ""), "[ \t]+", " ")))
    rows = tx.settle(df, poem_clean=F.array_join(F.filter(cleaned, lambda x: x != ""), "\n"), _to=field("recipient"), _tone=field("tone"), _keys=F.filter(F.transform(F.split(field("keywords_pipe"), "\\|"), tx.squeeze), lambda k: k != ""))
    kept, _ = clean_keywords(F.col("_keys"))
    reason = (
        F.when(F.coalesce(F.upper(field("decision")), F.lit("")) != "ACCEPT", "human_reject_or_unselected")
        .when(F.col("_to") == "", "metadata:recipient")
        .when(~F.size("_keys").isin(2, 3) | (F.size(kept) != F.size("_keys")), "metadata:keywords")
        .when(~F.col("_tone").isin(TONES), "metadata:tone")
        .when(F.col("poem_clean") == "", "metadata:poem")
    )
    to = F.when(F.lower("_to") == "chung chung", "mọi nhà").otherwise(F.col("_to"))
    rows = tx.settle(rows, reject_reason=reason, text_sha256=F.sha2("poem_clean", 256), recipient_scope=F.when(F.lower(to).isin(GENERAL), "general").otherwise("specific_or_group"))
    first = rows.where("reject_reason IS NULL").groupBy("text_sha256").agg(F.min(order).alias("_first"))
    rows = rows.join(first, "text_sha256", "left")
    again = F.when(F.col("reject_reason").isNull() & (F.col(order) != F.col("_first")), "exact_duplicate_after_cleaning")
    return rows.withColumn("reject_reason", F.coalesce("reject_reason", again)).drop("_to", "_tone", "_keys", "_first")
