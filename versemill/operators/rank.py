"""N-best ranking of candidate poems, weight sweeps and what is reported about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versemill.functions import tables as T
from versemill.functions import text as tx
from versemill.operators.evaluate import evaluate
from versemill.operators.lexical import assess


def components(df: DataFrame, text: str, keywords: str, target: Column, cliches: list[str]) -> DataFrame:
    """`df` with `ev` and `parts`: evaluator, diversity, cliche, keyword and length, each within [-1, 1]."""
    rows = tx.settle(evaluate(df, text, target), _s=F.coalesce(F.flatten(tx.line_tokens(tx.nfc(F.col(text)))), F.array().cast("array<string>")))
    s = F.col("_s")
    pairs = F.transform(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), s[i + 1]))
    rows = tx.settle(rows, _b=pairs)
    low = F.lower(F.col(text))
    hits = sum((F.contains(low, F.lit(c.strip().lower())).cast("int") for c in cliches if c.strip()), F.lit(0))
    keys = F.transform(F.col(keywords), lambda k: tx.tokens(k))
    found = F.filter(keys, lambda k: (F.size(k) > 0) & (F.size(F.array_except(k, s)) == 0))
    keyed = F.coalesce(F.size(F.col(keywords)), F.lit(0)) > 0
    parts = F.struct(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("ev")["overall"] / 100.0)).alias("evaluator"),
        F.when(F.size(s) < 2, 0.0).otherwise(F.try_divide(F.size(F.array_distinct("_b")).cast("double"), F.size("_b"))).alias("diversity"),
        (-F.least(F.lit(1.0), F.lit(0.25) * hits)).alias("cliche"),
        F.when(keyed, F.try_divide(F.size(found).cast("double"), F.size(F.col(keywords)))).otherwise(0.5).alias("keyword"),
        F.when(F.coalesce(target, F.lit(0)) <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(F.col("ev")["num_lines"] - target))).alias("length"),
    )
    return tx.settle(rows, parts=parts).drop("_s", "_b")


def total(parts: Column, weights: dict[str, float] | None = None, more: dict[str, Column] | None = None) -> Column:
    """The weighted sum to four places; components without a weight count nothing."""
    weights = weights or T.RANK_WEIGHTS
    out = F.lit(0.0)
    for name in ("evaluator", "diversity", "cliche", "keyword", "length"):
        out = out + F.lit(float(weights.get(name, 0.0))) * parts[name]
    for name, value in (more or {}).items():
        out = out + F.lit(float(weights.get(name, 0.0))) * value
    return F.bround(out, 4)


def rerank(df: DataFrame, pool: str = "pool", idx: str = "idx", guard: str | None = None) -> DataFrame:
    """`df` (with `score`) with `place` in its pool: certain errors last, then score, then pool order."""
    order = [F.col(guard).asc()] if guard else []
    return df.withColumn("place", F.row_number().over(Window.partitionBy(pool).orderBy(*order, F.desc("score"), F.col(idx))))


def guarded(df: DataFrame, text: str, keywords: str) -> DataFrame:
    """`df` with `hard_fail` of the lexical guard."""
    return assess(df, text, keywords).drop("orphans", "truncated")


def pearson(x: Column, y: Column) -> Column:
    """The correlation; 0 for less than two rows or a constant side."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def sweep(df: DataFrame, sets: dict[str, dict[str, float]]) -> DataFrame:
    """(weights, pools, top1_agree, mean_overall, mean_correlation): how each set of weights fares over all pools.

    Components are worked out once; the sets are a literal array, so the pools are only expanded, and
    partial aggregates serve all sets; of equal scores the first of the pool is the best.
    """
    names = F.array(*[F.struct(F.lit(n).alias("weights"), total(F.col("parts"), w).alias("score")) for n, w in sets.items()])
    rows = df.select("pool", "idx", F.col("ev")["overall"].alias("overall"), F.explode(names).alias("s")).select("pool", "idx", "overall", "s.weights", "s.score")
    best = F.max(F.struct("score", (-F.col("idx")).alias("i"), "overall"))["overall"]
    per = rows.groupBy("weights", "pool").agg(F.max("overall").alias("most"), best.alias("best"), pearson(F.col("score"), F.col("overall")).alias("corr"))
    agree = (F.abs(F.col("best") - F.col("most")) < 1e-9).cast("double")
    return per.groupBy("weights").agg(F.count("*").alias("pools"), F.bround(F.avg(agree), 4).alias("top1_agree"), F.bround(F.avg("best"), 3).alias("mean_overall"), F.round(F.avg("corr"), 2).alias("mean_correlation"))


def benchmark_totals(df: DataFrame) -> DataFrame:
    """One row of a ranked table (`ev`, `score`, `place`): means of the best of each pool, how many of them are
    valid, how often the best has the highest overall score, and the mean correlation of score and overall."""
    rows = df.select("pool", "place", "score", "ev", F.col("ev")["overall"].alias("o"))
    per = rows.groupBy("pool").agg(F.max(F.when(F.col("place") == 1, F.col("ev"))).alias("ev"), F.max("o").alias("most"), pearson(F.col("score"), F.col("o")).alias("corr"))
    mean = lambda f: F.bround(F.avg(F.col("ev")[f]), 1).alias(f)
    valid = F.sum(F.col("ev")["is_valid"].cast("long"))
    agree = (F.abs(F.col("ev")["overall"] - F.col("most")) < 1e-9).cast("double")
    return per.agg(
        F.count("*").alias("n"), *[mean(f) for f in ("scr", "tcr", "exact_rma", "slant_rma", "rma", "overall")], valid.alias("valid_n"), (F.count("*") - valid).alias("rejected_n"),
        F.bround(F.avg(agree), 3).alias("top1_agree"), F.round(F.avg("corr"), 3).alias("avg_corr"),
    )


def blend(df: DataFrame, weight: float, raw: str = "raw") -> DataFrame:
    """(pool, idx): the pick by score plus `weight` times the normalized rank of the collocation score.

    Certain errors are out unless a whole pool has them; equal values keep pool order.
    """
    w = Window.partitionBy("pool")
    rows = df.withColumn("_any", F.min(F.col("hard_fail").cast("int")).over(w)).where((F.col("_any") == 1) | ~F.col("hard_fail"))
    place = (F.row_number().over(w.orderBy(F.col(raw).asc_nulls_first(), "idx")) - 1) / F.greatest(F.lit(1), F.count("*").over(w) - 1)
    rows = rows.withColumn("_v", F.round(F.col("score") + weight * place, 9))
    return rows.withColumn("_rn", F.row_number().over(w.orderBy(F.desc("_v"), "idx"))).where("_rn = 1").select("pool", "idx")
