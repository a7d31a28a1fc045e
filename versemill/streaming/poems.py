"""Scoring, gating and counting poems as they arrive: an extension, with the batch operators as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.functions import text as tx
from versemill.operators.evaluate import evaluate, quality_reasons


def scored(stream: DataFrame, text: str = "text") -> DataFrame:
    """The stream with `ev` and `reasons`: row by row, so without state."""
    return quality_reasons(evaluate(stream, text), text)


def first_seen(stream: DataFrame, text: str, at: str, late: str = "1 day") -> DataFrame:
    """Each staged text once within the time that late rows may take; older state is dropped."""
    rows = stream.withColumn("text_sha256", F.sha2(tx.staged(F.col(text)), 256))
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(["text_sha256"])


def reason_counts(stream: DataFrame, at: str, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, reason, n): accepted poems and reasons against the others, by time."""
    each = F.when(F.size("reasons") == 0, F.array(F.lit("accepted"))).otherwise(F.col("reasons"))
    rows = stream.withWatermark(at, late).select(at, F.explode(each).alias("reason"))
    return rows.groupBy(F.window(at, every), "reason").agg(F.count("*").alias("n"))


def token_counts(stream: DataFrame, at: str, text: str = "text", every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, word, n) over a stream of texts."""
    rows = stream.withWatermark(at, late).select(at, F.explode(tx.words(F.col(text))).alias("word"))
    return rows.groupBy(F.window(at, every), "word").agg(F.count("*").alias("n"))
