"""Column functions on text: trimming, tokens, lines and phrases."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from versemill.functions import tables as T


def _nfc(texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in texts.to_pylist()], pa.string())


_nfc_udf = F.arrow_udf(_nfc, StringType())
#: Characters that can make a text differ from its NFC form; plain text never leaves the JVM.
_UNSETTLED = r"[\x{300}-\x{36f}\x{374}\x{37e}\x{387}\x{1100}-\x{11ff}\x{1f00}-\x{1fff}\x{2126}\x{212a}\x{212b}\x{93c}-\x{dff}]"


def nfc(text: Column) -> Column:
    """Unicode NFC; null stays null. Only texts that can differ from their NFC form go to Python."""
    return F.coalesce(_nfc_udf(F.when(text.rlike(_UNSETTLED), text)), text)


def strip(text: Column) -> Column:
    """Without white space of any kind around."""
    return F.regexp_replace(text, f"^{T.WS}+|{T.WS}+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none around."""
    return strip(F.regexp_replace(text, f"{T.WS}+", " "))


def normalize_text(text: Column) -> Column:
    """Stripped, in lower case and NFC; null becomes empty."""
    return nfc(F.coalesce(F.lower(strip(text)), F.lit("")))


def tokens(line: Column, punctuation: str = T.PUNCT) -> Column:
    """The cleaned, lower-case words of a text in NFC; empty ones dropped."""
    words = F.split(line, f"{T.WS}+")
    cleaned = F.transform(words, lambda w: F.lower(F.regexp_replace(w, f"^{punctuation}+|{punctuation}+$", "")))
    return F.filter(cleaned, lambda w: w != "")


def words(text: Column, pattern: str = T.WORD) -> Column:
    """All matches of a word pattern in the lower-case text."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def lines(text: Column) -> Column:
    """The lines of a text, split at newlines only."""
    return F.split(text, "\n")


def any_lines(text: Column) -> Column:
    """The lines of a text, split at line ends of any kind; none after the last end."""
    return F.filter(F.split(text, T.LINE_END), lambda x: x.isNotNull())


def line_tokens(text: Column) -> Column:
    """The words of each line, lines without words dropped; no lines for null."""
    found = F.filter(F.transform(lines(text), lambda x: tokens(x)), lambda x: F.size(x) > 0)
    return F.coalesce(found, F.array().cast("array<array<string>>"))


def staged(text: Column) -> Column:
    """NFC, one kind of line end, white space squeezed in each line, blank lines dropped."""
    split = F.split(nfc(F.coalesce(text, F.lit(""))), "\r\n|\r|\n")
    return F.array_join(F.filter(F.transform(split, squeeze), lambda x: x != ""), "\n")


def poem_text(text: Column) -> Column:
    """Without the leading label of the genre."""
    label = f"(?iu)^(?:thơ{T.WS}+lục{T.WS}+bát{T.WS}*:?{T.WS}*)"
    return strip(F.regexp_replace(strip(F.coalesce(text, F.lit(""))), label, ""))


def folded(text: Column) -> Column:
    """Lower case without any accent, đ as d, of a text in NFC; for loose matching only."""
    bare = F.translate(F.lower(text), *T.UNACCENT)
    return F.translate(F.regexp_replace(bare, r"[\x{300}-\x{36f}]", ""), "đ", "d")


def terms(text: Column) -> Column:
    """The distinct folded words longer than one character."""
    found = F.regexp_extract_all(nfc(text), F.lit(T.WORD_ANY), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, folded), lambda w: F.length(w) > 1))


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with the columns, worked out once for each row.

    The optimizer merges neighbouring projections and copies array expressions into every use; it does
    not merge over a generator, and one of a single element costs neither a shuffle nor a row.
    """
    kept = [c for c in df.columns if c not in columns]
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_settled")
    return df.select(*kept, made).select(*kept, *[F.col("_settled")[n].alias(n) for n in columns])


def joined(words: Column) -> Column:
    """Words as one string in which phrases can be looked up."""
    return F.concat(F.lit("\x01"), F.array_join(words, "\x01"), F.lit("\x01"))


def has_phrase(haystack: Column, needle: Column | str) -> Column:
    """True if the words of `needle` stand in the joined words one after the other; false if there are none."""
    if isinstance(needle, str):
        return F.contains(haystack, F.lit("\x01" + "\x01".join(needle.split()) + "\x01"))
    return (F.size(needle) > 0) & F.contains(haystack, joined(needle))


def has_word(text: Column, alternatives: list[str]) -> Column:
    """True if one of the phrases stands in the text between word edges, whatever the case."""
    return F.lower(text).rlike(f"(^|{T.EDGE})(" + "|".join(alternatives) + f")({T.EDGE}|$)")
