"""Deterministic samples: by digest, by quota, and blind pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versemill.plans.lineage import cut


def digest(*parts: Column) -> Column:
    """The order that stands for shuffling: the same on any cluster."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def lowest(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of the lowest digests, with `place`; a bounded heap in every task."""
    rows = df.withColumn("digest", digest(F.col(key))).orderBy("digest", key).limit(n)
    return rows.withColumn("place", F.row_number().over(Window.orderBy("digest", key)))


def quotas(df: DataFrame, strata: str, wanted: dict[int, int], key: str, within: list[str] = []) -> DataFrame:
    """Up to the wanted number of rows of each stratum (in each of `within`), by digest, with `place`."""
    table = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])
    rows = df.withColumn("_q", table[F.col(strata)]).where("_q IS NOT NULL").withColumn("digest", digest(F.col(key)))
    w = Window.partitionBy(*within, strata).orderBy("digest", key)
    most = max(wanted.values(), default=0)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).where("place <= _q").drop("_q")


def even_quotas(target: int, strata: tuple[int, ...] = (4, 6, 8)) -> dict[int, int]:
    """`target` spread over the strata, the remainder to the first ones."""
    return {s: target // len(strata) + (k < target % len(strata)) for k, s in enumerate(strata)}


def shortfall(sample: DataFrame, strata: str, wanted: dict[int, int], within: list[str] = []) -> DataFrame:
    """(stratum, have, want) of the strata that could not be filled; empty if all were."""
    table = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])
    have = sample.groupBy(*within, strata).agg(F.count("*").alias("have")).withColumn("want", table[F.col(strata)])
    return have.where("have < want")


def backfilled(df: DataFrame, strata: str, per_stratum: int, total: int, key: str) -> DataFrame:
    """`per_stratum` rows of each stratum in input order, the rest of `total` filled in input order."""
    w = Window.partitionBy(strata).orderBy(key)
    rows = df.withColumn("_p", F.row_number().over(w)).withColumn("backfill", F.col("_p") > per_stratum)
    return rows.orderBy("backfill", key).limit(total).drop("_p")


def blind_pairs(df: DataFrame, key: str, left: str, right: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(form(item, a, b), key(item, key, a_is_left)): sides and order by digest of the seed."""
    side = F.substring(digest(F.lit(seed), F.lit("side"), F.col(key)), 1, 1) < "8"
    rows = df.withColumn("a_is_left", side).withColumn("o", digest(F.lit(seed), F.lit("order"), F.col(key)))
    rows = rows.withColumn("item", F.concat(F.lit("I"), F.substring("o", 1, 12)))
    form = rows.select("item", F.when(F.col("a_is_left"), F.col(left)).otherwise(F.col(right)).alias("a"), F.when(F.col("a_is_left"), F.col(right)).otherwise(F.col(left)).alias("b"))
    return form, rows.select("item", key, "a_is_left")


def ordered_places(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """`df` with the place (from 1) of each row by columns that tell all rows apart.

    Rows are parted by ranges, which are counted first; a window holds one range only.
    """
    rows = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = rows.groupBy("_part").count().select("_part", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.withColumn("_within", within).join(F.broadcast(counts), "_part").withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_before", "_within")
