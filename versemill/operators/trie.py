"""Decoding assets as tables: prefix nodes of syllables with what may follow, and sequence checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.functions import phonetics as ph
from versemill.functions import tables as T
from versemill.operators.sample import ordered_places


def spelled(vocabulary: DataFrame, syllable: str = "syllable") -> DataFrame:
    """(syllable, root, tokens): a character is a token here; in the middle of a line a blank comes first."""
    s = F.col(syllable)
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    start = vocabulary.select(s.alias("syllable"), F.lit(0).alias("root"), chars(s).alias("tokens"))
    return start.union(vocabulary.select(s.alias("syllable"), F.lit(1).alias("root"), F.concat(F.array(F.lit(" ")), chars(s)).alias("tokens")))


def group_ids(groups: DataFrame) -> DataFrame:
    """(rhyme, gid): rhymes numbered in order, from 0."""
    return ordered_places(groups.select("rhyme").distinct(), "rhyme").select("rhyme", (F.col("place") - 1).cast("int").alias("gid"))


def attributed(sequences: DataFrame, groups: DataFrame) -> DataFrame:
    """`sequences` with the tone bit and the rhyme group of the syllable; groups may be missing."""
    s = F.col("syllable")
    b = ph.tone_bit(s)
    bit = F.when(b == 0, 1).when(b == 1, 2).when(b == 2, 4).otherwise(0)
    return sequences.where(ph.is_syllable(s)).select("*", bit.alias("bit"), ph.rhyme(s).alias("rhyme")).join(group_ids(groups), "rhyme", "left")


def nodes(sequences: DataFrame) -> DataFrame:
    """(root, path, token, tone_bits, gids, complete): every prefix of every sequence, with the tone bits and
    groups of all syllables below it, and whether one ends there. Path and tokens are joined by `sep`."""
    n = F.size("tokens")
    rows = sequences.select("root", "tokens", "bit", "gid", F.explode(F.sequence(F.lit(1), n)).alias("depth"))
    rows = rows.select("root", F.array_join(F.slice("tokens", F.lit(1), F.col("depth")), "\x01").alias("path"), F.element_at("tokens", F.col("depth")).alias("token"), "bit", "gid", (F.col("depth") == F.size("tokens")).alias("ends"))
    return rows.groupBy("root", "path", "token").agg(F.bit_or("bit").alias("tone_bits"), F.sort_array(F.collect_set("gid")).alias("gids"), F.bool_or("ends").alias("complete"))


def token_masks(sequences: DataFrame) -> DataFrame:
    """(token, tone_bits, gids): the same by token, wherever it stands."""
    rows = sequences.select(F.explode(F.array_distinct("tokens")).alias("token"), "bit", "gid")
    return rows.groupBy("token").agg(F.bit_or("bit").alias("tone_bits"), F.sort_array(F.collect_set("gid")).alias("gids"))


def matching_groups(rhymes: DataFrame, groups: DataFrame) -> DataFrame:
    """(rhyme, kind, other): which groups each rhyme goes with: equal ones, those of one canon, listed pairs.

    The relation is no equivalence, so it is a union of three equi-joins.
    """
    a, b = rhymes.select("rhyme").where("rhyme <> ''").distinct(), groups.select(F.col("rhyme").alias("other")).where("other <> ''").distinct()
    canon = a.withColumn("c", ph.canon(F.col("rhyme"))).join(b.withColumn("c", ph.canon(F.col("other"))), "c").select("rhyme", "other")
    both = [(x, y) for x, y in T.SLANT_PAIRS] + [(y, x) for x, y in T.SLANT_PAIRS]
    pairs = a.sparkSession.createDataFrame(both, "rhyme string, other string")
    listed = pairs.join(a, "rhyme").join(b, "other").select("rhyme", "other")
    every = canon.union(listed).distinct()
    return every.select("rhyme", F.when(F.col("rhyme") == F.col("other"), "exact").otherwise("slant").alias("kind"), "other")


def verify(sequences: DataFrame, trie: DataFrame) -> DataFrame:
    """(id, steps, allowed): whether every prefix of a token sequence is a node and the whole is complete.

    A semi-join per step at once: the prefixes of all sequences meet the nodes in one join.
    """
    rows = sequences.select("id", "root", "tokens", F.explode(F.sequence(F.lit(1), F.size("tokens"))).alias("depth"))
    rows = rows.select("id", "root", F.array_join(F.slice("tokens", F.lit(1), F.col("depth")), "\x01").alias("path"), (F.col("depth") == F.size("tokens")).alias("last"))
    met = rows.join(trie.select("root", "path", "complete"), ["root", "path"], "left")
    fine = F.col("complete").isNotNull() & (~F.col("last") | F.col("complete"))
    return met.groupBy("id").agg(F.count("*").alias("steps"), F.bool_and(fine).alias("allowed"))


def allowed(node_bits: Column, node_gids: Column, tone_mask: Column, wanted: Column) -> Column:
    """The strict test of one node: a tone it can still lead to is allowed, and a wanted rhyme group is below it."""
    return (node_bits.bitwiseAND(tone_mask) != 0) & (wanted.isNull() | F.arrays_overlap(node_gids, wanted))
