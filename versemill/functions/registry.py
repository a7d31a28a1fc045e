"""The column functions as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from versemill.functions import phonetics as ph
from versemill.functions import text as tx
from versemill.functions import tables as T


def _text(words: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + words.replace("\\", "\\\\").replace("'", "\\'") + "'"


def statements() -> list[str]:
    """CREATE FUNCTION statements, plain expressions; all stay in the JVM and inline into the plan. Texts must be in NFC."""
    mark = f"regexp_extract(x, {_text('[' + T.TONAL + ']')}, 0)"
    tone = f"CASE WHEN x = '' THEN 'unknown' WHEN {mark} = '' THEN 'ngang' " + " ".join(f"WHEN instr({_text(c)}, {mark}) > 0 THEN {_text(n)}" for n, c in T.OF_TONE.items()) + " END"
    bare = "x"
    for long, short in T.DETONE_LONG.items():
        bare = f"replace({bare}, {_text(long)}, {_text(short)})"
    bare = f"translate({bare}, {_text(T.DETONE[0])}, {_text(T.DETONE[1])})"
    rest = f"regexp_replace({bare}, {_text('^(' + '|'.join(T.ONSETS) + ')')}, '')"
    canon = "map(" + ", ".join(f"{_text(k)}, {_text(v)}" for k, v in T.SLANT_CANON.items()) + ")"
    pairs = ", ".join(_text("|".join(sorted(p))) for p in T.SLANT_PAIRS)
    word = f"regexp_replace(w, {_text(f'^{T.PUNCT}+|{T.PUNCT}+$')}, '')"
    return [
        f"CREATE OR REPLACE TEMPORARY FUNCTION lb_tone(x STRING) RETURNS STRING RETURN {tone}",
        f"CREATE OR REPLACE TEMPORARY FUNCTION lb_rhyme(x STRING) RETURNS STRING RETURN CASE WHEN length({rest}) > 2 AND {rest} RLIKE '^[uo][aeioâă]' THEN substr({rest}, 2) ELSE {rest} END",
        f"CREATE OR REPLACE TEMPORARY FUNCTION lb_kind_extracted(p STRING, q STRING) RETURNS STRING RETURN CASE WHEN p = '' OR q = '' THEN NULL WHEN p = q THEN 'exact' WHEN coalesce({canon}[p], p) = coalesce({canon}[q], q) OR concat_ws('|', least(p, q), greatest(p, q)) IN ({pairs}) THEN 'slant' END",
        "CREATE OR REPLACE TEMPORARY FUNCTION lb_rhyme_kind(a STRING, b STRING) RETURNS STRING RETURN lb_kind_extracted(lb_rhyme(a), lb_rhyme(b))",
        f"CREATE OR REPLACE TEMPORARY FUNCTION lb_tone_bit(x STRING) RETURNS INT RETURN CASE lb_tone(x) WHEN 'ngang' THEN 0 WHEN 'huyền' THEN 1 WHEN 'unknown' THEN NULL ELSE 2 END",
        f"CREATE OR REPLACE TEMPORARY FUNCTION lb_is_syllable(x STRING) RETURNS BOOLEAN RETURN x RLIKE {_text('^[' + T.SYLLABLE_LETTERS + ']+$')} AND length(regexp_replace(x, {_text('[^' + T.TONAL + ']')}, '')) + length(regexp_replace(x, {_text('[^' + T.DOUBLE + ']')}, '')) <= 1",
        f"CREATE OR REPLACE TEMPORARY FUNCTION lb_tokens(x STRING) RETURNS ARRAY<STRING> RETURN filter(transform(split(x, {_text(T.WS + '+')}), w -> lower({word})), w -> w <> '')",
    ]


def register(spark: SparkSession) -> list[str]:
    """Makes the functions and the table functions lb_lines and lb_windows known to SQL; their names are returned."""
    for s in statements():
        spark.sql(s)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION lb_lines(x STRING) RETURNS TABLE(pos INT, line STRING) RETURN SELECT pos, col FROM posexplode(split(x, '\\n'))")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION lb_windows(x STRING, n INT) RETURNS TABLE(pos INT, window STRING) RETURN "
        "SELECT k, array_join(slice(split(x, '\\n'), k + 1, n), '\\n') FROM explode(filter(sequence(0, greatest(0, size(split(x, '\\n')) - n)), k -> k + n <= size(split(x, '\\n')))) AS t(k)"
    )
    return ["lb_tone", "lb_rhyme", "lb_kind_extracted", "lb_rhyme_kind", "lb_tone_bit", "lb_is_syllable", "lb_tokens", "lb_lines", "lb_windows"]


def columns() -> dict[str, Column]:
    """The same as column expressions over x, or a and b, for those who build plans."""
    x, a, b = F.col("x"), F.col("a"), F.col("b")
    return {"lb_tone": ph.tone(x), "lb_rhyme": ph.rhyme(x), "lb_rhyme_kind": ph.rhyme_kind(a, b), "lb_tokens": tx.tokens(x)}
