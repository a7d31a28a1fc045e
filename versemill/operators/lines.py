"""Lines, couplets, windows and blocks of verse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versemill.functions import phonetics as ph
from versemill.functions import tables as T
from versemill.functions import text as tx


def line_table(df: DataFrame, key: str, text: str = "text", keep: list[str] = [], punctuation: str = T.PUNCT) -> DataFrame:
    """(id, pos, tk, *keep): the words of each line that has some; pos counts such lines from 0."""
    found = F.filter(F.transform(tx.lines("norm"), lambda x: tx.tokens(x, punctuation)), lambda x: F.size(x) > 0)
    return df.select(F.col(key).alias("id"), *keep, tx.nfc(F.col(text)).alias("norm")).select("id", *keep, F.posexplode(found).alias("pos", "tk"))


def couplets(df: DataFrame, key: str, text: str = "text", keep: list[str] = []) -> DataFrame:
    """(id, nth, l6, b6, b8, next6, *keep): each six-word line followed by one of eight, other lines dropped.

    next6 is the sixth word of the next couplet's first line, null at the end of the text.
    """
    cleaned = df.select(key, *keep, tx.poem_text(tx.nfc(F.col(text))).alias("_text"))
    w = Window.partitionBy("id").orderBy("pos")
    rows = line_table(cleaned, key, "_text", keep, T.PUNCT_CORPUS).where(F.size("tk").isin(6, 8))
    rows = rows.withColumn("bat", F.lead("tk").over(w)).where((F.size("tk") == 6) & (F.size("bat") == 8))
    sixth, eighth = F.element_at("tk", 6), F.element_at("bat", 8)
    rows = rows.select("id", *keep, F.row_number().over(w).alias("nth"), sixth.alias("l6"), F.element_at("bat", 6).alias("b6"), eighth.alias("b8"))
    return rows.withColumn("next6", F.lead("l6").over(Window.partitionBy("id").orderBy("nth")))


def rhyme_pairs(couplet_rows: DataFrame, keep: list[str] = []) -> DataFrame:
    """(w1, w2, *keep), one row for each pair of words at rhyming places that are both bằng; w1 <= w2."""
    pairs = F.array(F.struct(F.col("l6").alias("a"), F.col("b6").alias("b")), F.struct(F.col("b8").alias("a"), F.col("next6").alias("b")))
    rows = couplet_rows.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.a", "p.b").where("b IS NOT NULL")
    rows = rows.where(ph.is_bang(F.col("a")) & ph.is_bang(F.col("b")))
    return rows.select(*keep, F.least("a", "b").alias("w1"), F.greatest("a", "b").alias("w2"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(w1, w2, frequency)."""
    return pairs.groupBy("w1", "w2").agg(F.count("*").alias("frequency"))


def rhyme_dictionary(pairs: DataFrame) -> DataFrame:
    """(rhyme, words): the sorted distinct words of each rhyme; words without a rhyme are left out.

    Words are folded to distinct ones before their rhymes are looked at.
    """
    named = pairs.select(F.explode(F.array("w1", "w2")).alias("word")).distinct()
    named = named.select(ph.rhyme(F.col("word")).alias("rhyme"), "word").where("rhyme <> ''")
    return named.groupBy("rhyme").agg(F.sort_array(F.collect_set("word")).alias("words"))


def merge_dictionaries(pairs: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of equal pairs added up (1 where there is none), word sets of equal rhymes united."""
    merged = pairs.groupBy("w1", "w2").agg(F.sum(F.coalesce("frequency", F.lit(1))).alias("frequency"))
    words = groups.select("rhyme", F.explode("words").alias("word")).distinct()
    return merged, words.groupBy("rhyme").agg(F.sort_array(F.collect_set("word")).alias("words"))


def clean_pairs(pairs: DataFrame, min_frequency: int = 2) -> DataFrame:
    """Pairs that are frequent enough, of two valid syllables; frequency is asked first."""
    return pairs.where(F.col("frequency") >= min_frequency).where(ph.is_syllable(F.col("w1")) & ph.is_syllable(F.col("w2")))


def surviving_groups(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """The groups with only those words that are left in the pairs; groups without any are dropped."""
    left = pairs.select(F.explode(F.array("w1", "w2")).alias("word")).distinct()
    rows = groups.select("rhyme", F.explode("words").alias("word")).join(left, "word", "left_semi")
    return rows.groupBy("rhyme").agg(F.sort_array(F.collect_set("word")).alias("words"))


def syllable_vocabulary(df: DataFrame, text: str, dictionary: DataFrame, blocked: list[str], min_count: int = 2, min_len: int = 1) -> DataFrame:
    """(syllable): corpus tokens seen often enough and fit for the lexicon, with the dictionary's words.

    Validity is asked of distinct tokens only, after counting.
    """
    found = df.select(F.explode(tx.tokens(tx.nfc(F.col(text)), T.PUNCT_CORPUS)).alias("syllable")).groupBy("syllable").count()
    found = found.where(F.col("count") >= min_count).where(ph.is_lexicon_syllable(F.col("syllable"))).select("syllable")
    named = dictionary.select(F.explode("words").alias("syllable")).where(ph.is_lexicon_syllable(F.col("syllable")))
    return found.union(named).distinct().where(~F.col("syllable").isin(blocked) & (F.length("syllable") >= min_len))


def rendered_lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(id, pos, line): squeezed lines with something on them, pos from 0."""
    squeezed = F.filter(F.transform(tx.lines(tx.nfc(F.col(text))), tx.squeeze), lambda x: x != "")
    return df.select(F.col(key).alias("id"), F.posexplode(squeezed).alias("pos", "line"))


def windows(rows: DataFrame, size: int = 4) -> DataFrame:
    """(id, pos, window): every run of `size` neighbouring lines, joined, with its first position."""
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(0, size - 1)
    found = rows.select("id", "pos", F.collect_list("line").over(w).alias("w"))
    return found.where(F.size("w") == size).select("id", "pos", F.array_join("w", "\n").alias("window"))


def season(text: Column) -> Column:
    """True if a text speaks of the season."""
    return tx.has_word(text, T.SEASON)


def season_pages(rows: DataFrame, first: int = 20) -> DataFrame:
    """(id, page_is_tet): whether the first lines of a page speak of the season."""
    head = rows.where(F.col("pos") < first)
    return head.groupBy("id").agg(F.bool_or(season(F.col("line"))).alias("page_is_tet"))


def greedy(offsets: Column, size: int = 4) -> Column:
    """The offsets kept when each is taken unless it overlaps the last one taken; a fold over the sorted array."""
    start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<int>").alias("taken"))
    take = lambda s, o: F.struct(o.alias("last"), F.concat(s["taken"], F.array(o)).alias("taken"))
    step = lambda s, o: F.when(s["last"].isNull() | (o >= s["last"] + size), take(s, o)).otherwise(s)
    return F.aggregate(F.sort_array(offsets), start, step, lambda s: s["taken"])


def blocks(rows: DataFrame, size: int = 4, context: int | None = None) -> DataFrame:
    """(id, block, kind, first_line, block_text, before, after, remainder): lines cut into full blocks, with context.

    kind tells a text of one block from leading, trailing and interior ones. `context` is the number of lines
    before and after that a block carries. With None it carries all of them, so the result grows with the
    square of a text; for long texts name a number, first_line (from 0) leads to the rest.
    """
    whole = rows.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("all"))
    n = F.size("all")
    full = F.floor(n / size).cast("int")
    parts = whole.where(n >= size).select("id", "all", full.alias("full"), n.alias("n"), F.explode(F.sequence(F.lit(0), full - 1)).alias("k"))
    start = F.col("k") * size
    kind = F.when(F.col("n") == size, "native_four_line").when(F.col("k") == 0, "derived_leading")
    kind = kind.when((F.col("k") == F.col("full") - 1) & (F.col("n") % size == 0), "derived_trailing").otherwise("derived_interior")
    join = lambda c: F.array_join(c, "\n")
    reach = F.col("n") if context is None else F.lit(context)
    begin = F.greatest(F.lit(0), start - reach)
    return parts.select(
        "id",
        (F.col("k") + 1).alias("block"),
        kind.alias("kind"),
        start.alias("first_line"),
        join(F.slice("all", start + 1, size)).alias("block_text"),
        join(F.slice("all", begin + 1, start - begin)).alias("before"),
        join(F.slice("all", start + size + 1, reach)).alias("after"),
        (F.col("n") % size).alias("remainder"),
    )
