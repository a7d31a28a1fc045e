"""Visually identical text with different characters: script-aware repair to one consistent form."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.llm import textform as tf
from versemill.plans.lineage import cut

_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
#: Where a look-alike can be, composed with a mark or not.
_ANY = r"[Ͱ-ԯᲀ-᲏ἀ-῿" + "".join(tf.LATIN_LOOKALIKES) + "]"
_odd = regex.compile(_ANY)


def repaired(token: str, latin_text: bool) -> str | None:
    """The token in Latin letters if its dominant script is Latin and it has look-alikes, else None.

    The letters of one script only decide; a token made of look-alikes alone follows its text.
    """
    parts = unicodedata.normalize("NFD", token)
    folded = tf.fold_lookalikes(parts)
    if folded == parts:
        return None
    bare = tf._lookalike.sub("", parts)
    latin, other = len(tf._latin.findall(bare)), sum(c.isalpha() and not tf._latin.match(c) for c in bare)
    if latin > other or latin == other == 0 and latin_text:
        return unicodedata.normalize("NFC", folded)
    return None


def mixed_tokens(text: str) -> dict[str, str]:
    """The tokens of a text that have a repair, with it."""
    latin = tf.is_latin(unicodedata.normalize("NFD", text))
    found = {}
    for token in _TOKEN.findall(text):
        if _odd.search(token) and token not in found and (fixed := repaired(token, latin)) is not None:
            found[token] = fixed
    return found


def _forms(rows: DataFrame) -> DataFrame:
    """(rec, raw, form, mixed): digest of the stored text, its form without substitution, its tokens
    of mixed scripts with their repairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            forms = tf.reader_forms(texts, fold=False)
            odd = pc.match_substring_regex(forms, _ANY).to_pylist()
            mixed = [list(mixed_tokens(x).items()) if o else [] for x, o in zip(forms.to_pylist(), odd)]
            raw = [None if x is None else xxhash.xxh64_intdigest(x.encode()) - 2**63 for x in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(raw, pa.int64()), forms, pa.array(mixed, pa.map_(pa.string(), pa.string()))],
                ["rec", "raw", "form", "mixed"],
            )

    return rows.mapInArrow(run, "rec long, raw long, form string, mixed map<string,string>")


def _vocabulary(forms: DataFrame) -> DataFrame:
    """(w): the words in lower case that are written without any look-alike somewhere in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            spaced = pc.replace_substring_regex(pc.utf8_lower(batch.column(0)), r"[^\p{L}\p{M}]+", " ")
            words = pc.unique(pc.split_pattern(spaced, " ").flatten())
            new = [w for w in pc.filter(words, pc.invert(pc.match_substring_regex(words, _ANY))).to_pylist() if w and w not in seen]
            if len(seen) < 1_000_000:
                seen.update(new)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string())], ["w"])

    return forms.select("form").mapInArrow(run, "w string").distinct()


def _apply(rows: DataFrame) -> DataFrame:
    """The forms with the accepted repairs (fix) in place of their tokens."""

    def one(form: str | None, fix: list | None) -> str | None:
        if form is None or not fix:
            return form
        named = dict(fix)
        return _TOKEN.sub(lambda m: named.get(m[0], m[0]), form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [one(f, x) for f, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["rec", "raw", "form"])

    return rows.mapInArrow(run, "rec long, raw long, form string")


def unified(df: DataFrame, key: str = "rec_no", text: str = "text") -> DataFrame:
    """(rec, raw, form): every row's text in the one form of what a reader sees.

    Width, kinds of blank and line break, the way marks are stored and what is not visible are
    settled by rule. Look-alike letters are settled by script: in a token whose dominant script is
    Latin they are replaced if the word that comes out is in the corpus vocabulary. Tokens that are of one script, but
    have letters that are look-alikes within it (a stroke through a D that is another letter), are repaired by the
    same test. Nothing else is changed. Null stays null; repeated rows give repeated rows; rows without a key are
    left out.

    Tokens and vocabulary meet in joins, so neither has to fit into one place.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("rec"), F.col(text).cast("string").alias("text"))
    forms = cut(_forms(rows), "forms")
    odd = forms.where(F.size("mixed") > 0)
    tokens = odd.select(F.explode("mixed").alias("token", "fix")).distinct().withColumn("w", F.lower("fix"))
    accepted = cut(tokens.join(_vocabulary(forms), "w", "left_semi").select("token", "fix"), "accepted")
    each = odd.select("rec", "raw", "form", F.explode(F.map_keys("mixed")).alias("token")).distinct()
    fixes = each.join(accepted, "token", "left").groupBy("rec", "raw", "form").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("fix").isNotNull(), F.struct("token", "fix")))).alias("fix")
    )
    again = odd.select("rec", "raw", "form").join(fixes, ["rec", "raw", "form"])
    return forms.where(F.size("mixed") <= 0).select("rec", "raw", "form").union(_apply(again))


def lookalike_pairs(df: DataFrame, key: str = "rec_no", text: str = "text") -> DataFrame:
    """(rec_a, rec_b), rec_a < rec_b: texts that look the same but are stored differently.

    Null and blank texts take no part. Rows of one text are a class; classes of one form are paired
    and only then expanded, as every pair of records is asked for. So a text that a third of the
    rows hold in one spelling adds no comparison.
    """
    rows = unified(df, key, text).where(F.col("form").isNotNull() & (F.col("form") != ""))
    rows = cut(rows.select("rec", "raw", F.xxhash64("form").alias("k1"), F.xxhash64(F.lit("2"), F.reverse("form")).alias("k2")).distinct(), "keys")
    several = rows.groupBy("k1", "k2").agg(F.min("raw").alias("x"), F.max("raw").alias("y")).where("x <> y").select("k1", "k2")
    rows = cut(rows.join(several, ["k1", "k2"], "left_semi"), "several")
    kinds = rows.select("k1", "k2", "raw").distinct()
    pairs = kinds.withColumnRenamed("raw", "ra").join(kinds.withColumnRenamed("raw", "rb"), ["k1", "k2"]).where("ra < rb")
    left, right = (rows.select("k1", "k2", F.col("raw").alias(r), F.col("rec").alias(x)) for r, x in (("ra", "x"), ("rb", "y")))
    both = pairs.join(left, ["k1", "k2", "ra"]).join(right, ["k1", "k2", "rb"]).where("x <> y")
    return both.select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b")).distinct()
