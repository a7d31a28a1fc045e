"""Splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.operators.components import connected_components
from versemill.plans.lineage import cut

# Identifiers that name nothing.
NOTHING = ["", "null", "none", "nan", "n/a", "na", "-", "--", "?", "unknown", "undefined", "nil"]
SPLITS = {"train": "train", "training": "train", "dev": "dev", "val": "dev", "valid": "dev", "validation": "dev", "test": "test", "testing": "test"}


def identifier(value: Column, prefix: str) -> Column:
    """An identifier without case, blanks and prefix; null if it names nothing."""
    bare = F.regexp_replace(F.lower(value), r"[\s\p{Z}\p{Cf}]+", "")
    bare = F.regexp_replace(bare, f"^{prefix}", "")
    return F.when(~bare.isin(NOTHING), bare)


def split_name(value: Column) -> Column:
    """train, dev or test, whatever the spelling; null for anything else."""
    bare = F.regexp_replace(F.lower(value), r"[\s\p{Z}\p{Cf}]+", "")
    return F.create_map(*[F.lit(x) for kv in SPLITS.items() for x in kv])[bare]


def related(df: DataFrame, key: str = "rec_no", cluster: str = "duplicate_cluster", work: str = "work_id") -> DataFrame:
    """(rec, split, group_no) of every row; group_no is the least key of what belongs together.

    The nodes of the graph are the entities, not the records: a record that has a cluster and a work
    links the two, and equal links are folded before the shuffle. So a cluster that a third of all
    rows share is one node, and rows only look their component up. A row without any entity is a
    group of its own.
    """
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("rec"),
        split_name(F.col("split")).alias("split"),
        F.xxhash64(F.lit("c"), identifier(F.col(cluster), "cluster-")).alias("c"),
        F.xxhash64(F.lit("w"), identifier(F.col(work), "fsoft:")).alias("w"),
        identifier(F.col(cluster), "cluster-").isNotNull().alias("has_c"),
        identifier(F.col(work), "fsoft:").isNotNull().alias("has_w"),
    )
    rows = rows.select("rec", "split", F.when(F.col("has_c"), F.col("c")).alias("c"), F.when(F.col("has_w"), F.col("w")).alias("w"))
    links = rows.where("c IS NOT NULL AND w IS NOT NULL").select("c", "w").distinct()
    label = cut(connected_components(links, "c", "w"), "labels")
    rows = rows.withColumn("entity", F.coalesce("c", "w"))
    label = label.select(F.col("node").alias("entity"), "component")
    rows = cut(rows.join(label, "entity", "left").select("rec", "split", F.coalesce("component", "entity").alias("of")), "related")
    least = rows.where("of IS NOT NULL").groupBy("of").agg(F.min("rec").alias("group_no"))
    return rows.join(least, "of", "left").select("rec", "split", F.coalesce("group_no", "rec").alias("group_no"))


def torn_groups(df: DataFrame, key: str = "rec_no") -> DataFrame:
    """(key, group_no) of the records whose group lies in more than one of train, dev and test."""
    rows = cut(related(df, key), "groups")
    torn = rows.groupBy("group_no").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select("group_no")
    return rows.join(torn, "group_no", "left_semi").select(F.col("rec").alias(key), "group_no").distinct()


def assign_splits(df: DataFrame, shares: dict[str, float] | None = None, seed: str = "split", key: str = "rec_no") -> DataFrame:
    """(key, group_no, new_split): each group goes whole where the hash of its number falls.

    Equal tables give equal splits on any cluster. A group can't be parted, so a share is met as
    closely as the sizes of the groups allow.
    """
    shares = shares or {"train": 0.8, "dev": 0.1, "test": 0.1}
    point = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.col("group_no").cast("string")), 256), 1, 8), 16, 10).cast("double") / 2.0**32
    total, bound, choice = sum(shares.values()), 0.0, None
    names = list(shares)
    for name in names[:-1]:
        bound += shares[name] / total
        choice = F.when(point < bound, name) if choice is None else choice.when(point < bound, name)
    new = F.lit(names[-1]) if choice is None else choice.otherwise(names[-1])
    return related(df, key).select(F.col("rec").alias(key), "group_no", new.alias("new_split"))
