"""Exact and near duplicates by SimHash, clusters, splits by hash and leak checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versemill.functions import tables as T
from versemill.functions import text as tx
from versemill.operators.components import connected_components
from versemill.plans.lineage import cut


def keep_first(df: DataFrame, text: Column, order: str) -> DataFrame:
    """The first row of each text, by a digest of it; the digest is folded before the shuffle."""
    rows = df.withColumn("text_sha256", F.sha2(text, 256))
    first = rows.groupBy("text_sha256").agg(F.min(order).alias(order), F.count("*").alias("copies"))
    return rows.drop("text_sha256").join(first, order)


def token_hash(token: Column, kind: str = "md5") -> tuple[Column, Column]:
    """The upper and lower 32 bits of a token's hash, as longs; md5 stays in the JVM."""
    if kind != "md5":
        raise ValueError("only md5 is built in")
    part = lambda k: F.conv(F.substring(F.md5(token), k, 8), 16, 10).cast("long")
    return part(1), part(9)


def simhash(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(id, hi, lo): 64 signed sums over the distinct words of each text; a sum of 0 sets its bit.

    Words are hashed once each; the sums are partial aggregates. Texts without words have all bits set;
    null texts are left out.
    """
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(T.WORD_ANY), F.lit(0)))
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.explode_outer(found).alias("w"))
    hi, lo = token_hash(F.col("w"))
    hashed = rows.select("w").where("w IS NOT NULL").distinct().select("w", hi.alias("h"), lo.alias("l"))
    rows = rows.join(hashed, "w", "left")
    sums = [F.sum(F.when(F.col(p).isNull(), 0).when(F.shiftright(p, k).bitwiseAND(1) == 1, 1).otherwise(-1)).alias(f"{p}{k}") for p in "hl" for k in range(32)]
    bits = lambda p: sum((F.when(F.col(f"{p}{k}") >= 0, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k in range(32)), F.lit(0).cast("long"))
    return rows.groupBy("id").agg(*sums).select("id", bits("h").alias("hi"), bits("l").alias("lo"))


def near_pairs(hashes: DataFrame, reach: int = 3, bucket: int = 128) -> tuple[DataFrame, DataFrame]:
    """(members(id, rep), pairs(a, b, distance)): equal hashes are one class, named by its least id; pairs
    of classes whose hashes differ in at most `reach` bits, reach being 3 at most.

    Of four bands of 16 bits one is equal in any such pair. Buckets of more than `bucket` classes are not
    given up: their pairs also agree in one of four parts of the other 48 bits, which splits them exactly.
    """
    if reach > 3:
        raise ValueError("four bands hold for three bits at most")
    reps = hashes.groupBy("hi", "lo").agg(F.min("id").alias("rep"))
    members = hashes.join(reps, ["hi", "lo"]).select("id", "rep")
    h, l = F.col("hi"), F.col("lo")
    bands = [F.shiftright(h, 16), h.bitwiseAND(65535), F.shiftright(l, 16), l.bitwiseAND(65535)]
    keyed = F.array(*[F.struct(F.lit(k).alias("band"), b.alias("key")) for k, b in enumerate(bands)])
    rows = reps.select("rep", "hi", "lo", F.explode(keyed).alias("b")).select("rep", "hi", "lo", "b.band", "b.key")
    rows = cut(rows, "bands")
    large = cut(rows.groupBy("band", "key").count().where(F.col("count") > bucket).select("band", "key"), "large")
    pick = lambda k: F.when(F.col("band") <= k, bands[k + 1]).otherwise(bands[k])
    rest = F.shiftleft(pick(0), 32).bitwiseOR(F.shiftleft(pick(1), 16)).bitwiseOR(pick(2))
    parts = F.array(*[F.struct(F.lit(k).alias("part"), F.shiftright(rest, 12 * k).bitwiseAND(4095).alias("sub")) for k in range(4)])
    small = rows.join(large, ["band", "key"], "left_anti").withColumn("part", F.lit(-1)).withColumn("sub", F.lit(0).cast("long"))
    if large.isEmpty():
        every = small
    else:
        split = rows.join(large, ["band", "key"], "left_semi").withColumn("p", F.explode(parts)).select("band", "key", "rep", "hi", "lo", F.col("p.part").alias("part"), F.col("p.sub").alias("sub"))
        every = small.select("band", "key", "rep", "hi", "lo", "part", "sub").union(split)
    keys = ["band", "key", "part", "sub"]
    a = every.select(*keys, F.col("rep").alias("a"), F.col("hi").alias("ha"), F.col("lo").alias("la"))
    b = every.select(*keys, F.col("rep").alias("b"), F.col("hi").alias("hb"), F.col("lo").alias("lb"))
    distance = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb"))) + F.bit_count(F.col("la").bitwiseXOR(F.col("lb")))
    return members, a.join(b, keys).where("a < b").select("a", "b", distance.alias("distance")).where(F.col("distance") <= reach).distinct()


def clusters(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, cluster): `cluster-` and a digest of the least id that is linked, directly or through others."""
    label = connected_components(pairs, "a", "b")
    named = members.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left")
    least = F.coalesce("component", "rep").cast("string")
    return named.select("id", F.concat(F.lit("cluster-"), F.substring(F.sha2(least, 256), 1, 16)).alias("cluster"))


def hash_split(cluster: Column, train: float = 0.8, dev: float = 0.1) -> Column:
    """train, dev or test by the first 32 bits of the digest of the cluster."""
    point = F.conv(F.substring(F.sha2(cluster, 256), 1, 8), 16, 10).cast("long") / F.lit(4294967295.0)
    return F.when(point < train, "train").when(point < train + dev, "dev").otherwise("test")


def leaks(df: DataFrame, cluster: str, split: str) -> DataFrame:
    """(cluster, splits): clusters whose records lie in more than one split; empty if splits are sound."""
    held = df.where(F.col(cluster).isNotNull() & F.col(split).isNotNull()).groupBy(F.col(cluster).alias("cluster"))
    return held.agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    """(key, n): identifiers that more than one record has."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def split_counts(df: DataFrame, split: str, text: str = "text") -> DataFrame:
    """(split, records, tokens): tokens are parted by white space."""
    words = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), f"{T.WS}+"), lambda w: w != ""))
    return df.groupBy(F.col(split).alias("split")).agg(F.count("*").alias("records"), F.sum(words).alias("tokens"))


def numbered(df: DataFrame, group: str, order: str, name: str = "place", step: int = 1 << 16) -> DataFrame:
    """`df` with the place (from 1) of each row in its group by the whole number `order`, ties in any order.

    Rows are counted by stretches of `step` numbers first, so no window holds more than one stretch of a
    group, however large the group is.
    """
    rows = df.withColumn("_part", F.floor(F.col(order) / step))
    counts = rows.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(group, "_part").orderBy(order))
    rows = rows.withColumn("_within", within)
    rows = rows.join(counts, rows[group].eqNullSafe(counts["_g"]) & rows["_part"].eqNullSafe(counts["_p"]))
    return rows.withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_g", "_p", "_before", "_within")


def merge_materials(df: DataFrame, text: Column, order: str, ref: Column) -> tuple[DataFrame, DataFrame]:
    """(materials(text_sha256, first, n), references(text_sha256, place, ref)): rows of one text as one
    material, named by its first row, and the references of all its rows, one for each row, in order.

    References stay rows of a table, as a material may have any number of them. A null text is a material too.
    """
    rows = df.select(F.sha2(text, 256).alias("text_sha256"), F.col(order).alias("o"), ref.alias("ref"))
    materials = rows.groupBy("text_sha256").agg(F.min("o").alias("first"), F.count("*").alias("n"))
    return materials, numbered(rows, "text_sha256", "o").select("text_sha256", "place", "ref")


def staging_stats(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row on the staging of a corpus: input_rows, exact_duplicates_removed, staging_rows, duplicate_clusters,
    near_duplicate_links and the records of each split.

    Null and blank texts are no input. Links are pairs of different fingerprints within reach; records of
    one fingerprint are linked without being counted in pairs. A cluster lies in one split by its digest.
    """
    rows = cut(df.select(F.col(key), tx.staged(F.col(text)).alias("staged")).where("staged <> ''"), "staged")
    unique = cut(keep_first(rows, F.col("staged"), key).select(key, "staged"), "unique")
    members, pairs = near_pairs(cut(simhash(unique, key, "staged"), "fingerprints"))
    pairs = cut(pairs, "links")
    named = clusters(members, pairs).withColumn("split", hash_split(F.col("cluster")))
    of = lambda s: F.count_if(F.col("split") == s).alias(s)
    found = named.agg(F.countDistinct("cluster").alias("duplicate_clusters"), of("train"), of("dev"), of("test"))
    sizes = rows.agg(F.count("*").alias("input_rows")).join(F.broadcast(unique.agg(F.count("*").alias("staging_rows"))))
    sizes = sizes.join(F.broadcast(pairs.agg(F.count("*").alias("near_duplicate_links")))).join(F.broadcast(found))
    removed = (F.col("input_rows") - F.col("staging_rows")).alias("exact_duplicates_removed")
    return sizes.select("input_rows", removed, "staging_rows", "duplicate_clusters", "near_duplicate_links", "train", "dev", "test")
