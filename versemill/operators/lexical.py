"""Lexical guard, coverage and acceptance of poems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.functions import tables as T
from versemill.functions import text as tx


def guard_tokens(text: Column) -> Column:
    """The words that the guard sees, over all lines."""
    return tx.words(tx.nfc(text), T.WORD)


def orphan_vowels(tokens: Column) -> Column:
    """Tokens that can't be words: truncated syllables."""
    return F.filter(tokens, lambda t: t.isin(T.ORPHAN_VOWELS))


def truncated_keywords(tokens: Column, keywords: Column, joined: Column) -> Column:
    """For each keyword of several words: places where all but the last word agree and the last is cut short."""

    def of(keyword: Column) -> Column:
        want = guard_tokens_of(keyword)
        k = F.size(want)
        # most texts do not hold the words before the last at all, and are settled by one look
        held = F.contains(joined, tx.joined(F.slice(want, F.lit(1), F.greatest(k - 1, F.lit(0)))))
        starts = F.when((k >= 2) & (F.size(tokens) >= k) & held, F.sequence(F.lit(1), F.size(tokens) - k + 1)).otherwise(F.array().cast("array<int>"))
        last = F.element_at(want, -1)

        def cut(i: Column) -> Column:
            got = F.slice(tokens, i, k)
            end = F.element_at(got, -1)
            return (F.slice(got, F.lit(1), k - 1) == F.slice(want, F.lit(1), k - 1)) & (end != last) & last.startswith(end)

        return F.transform(F.filter(starts, cut), lambda i: F.array_join(F.slice(tokens, i, k), " "))

    return F.flatten(F.transform(keywords, of))


def guard_tokens_of(keyword: Column) -> Column:
    return F.regexp_extract_all(F.lower(keyword), F.lit(T.WORD), F.lit(0))


def assess(df: DataFrame, text: str = "text", keywords: str | None = None) -> DataFrame:
    """`df` with `orphans`, `truncated` and `hard_fail`; only certain errors count. Null texts have none."""
    rows = tx.settle(df, _g=F.coalesce(guard_tokens(F.col(text)), F.array().cast("array<string>")))
    rows = tx.settle(rows, _j=tx.joined(F.col("_g")))
    cut = truncated_keywords(F.col("_g"), F.col(keywords), F.col("_j")) if keywords else F.array().cast("array<string>")
    rows = tx.settle(rows, orphans=orphan_vowels(F.col("_g")), truncated=F.coalesce(cut, F.array().cast("array<string>"))).drop("_g", "_j")
    return rows.withColumn("hard_fail", (F.size("orphans") > 0) | (F.size("truncated") > 0))


def recipients(words: Column) -> Column:
    """The groups of people the joined words of a wish name, in fixed order; con cháu only right after the verb."""
    found = []
    for name in T.RECIPIENTS:
        here = tx.has_phrase(words, name)
        if name == "con cháu":
            here = here & (tx.has_phrase(words, "chúc con cháu") | tx.has_phrase(words, "chúc cho con cháu"))
        found.append(F.when(here, name))
    return F.array_compact(F.array(*found))


def _first_alias(words: Column, aliases: list[str]) -> Column:
    return F.coalesce(*[F.when(tx.has_phrase(words, a), a) for a in aliases])


def coverage(df: DataFrame, text: str, intent: str, keywords: str) -> DataFrame:
    """`df` with `coverage`: counts of exact and looser keyword hits, recipients named, and the reasons
    against acceptance; a poem is one list of words, so phrases run over line ends."""
    none = F.array().cast("array<string>")
    rows = tx.settle(df, _w=tx.joined(F.coalesce(tx.tokens(tx.nfc(F.col(text))), none)), _r=tx.joined(F.coalesce(tx.tokens(tx.nfc(F.col(intent))), none)))
    rows = tx.settle(rows, _r=recipients(F.col("_r")))
    w = F.col("_w")
    matched = {name: _first_alias(w, aliases) for name, aliases in T.RECIPIENTS.items()}
    missing = F.array_compact(F.array(*[F.when(F.array_contains("_r", name) & m.isNull(), name) for name, m in matched.items()]))
    rows = tx.settle(rows, _miss=F.coalesce(missing, none))
    keys = F.transform(F.col(keywords), lambda k: tx.tokens(k))
    rows = tx.settle(rows, _k=F.coalesce(keys, F.array().cast("array<array<string>>")))
    exact = F.filter("_k", lambda k: tx.has_phrase(w, k))
    loose = F.array_compact(F.array(*[F.when(_first_alias(w, a).isNotNull(), name) for name, a in T.KEYWORD_ALIASES.items()]))
    rows = tx.settle(rows, _loose=loose)
    semantic = F.filter("_k", lambda k: tx.has_phrase(w, k) | F.array_contains("_loose", F.array_join(k, " ")))
    rows = tx.settle(rows, _c=F.struct(F.size(exact).alias("exact"), F.size(semantic).alias("semantic"), F.least(F.lit(2), F.size("_k")).alias("minimum")))
    c = F.col("_c")
    reasons = F.array(F.when(F.size("_miss") > 0, "missing_recipient"), F.when(c["exact"] < 1, "no_exact_keyword"), F.when(c["semantic"] < c["minimum"], "insufficient_semantic_keywords"))
    out = F.struct(c["exact"].alias("exact_count"), c["semantic"].alias("semantic_count"), c["minimum"].alias("minimum"), F.col("_r").alias("recipients"), F.col("_miss").alias("missing"), F.array_compact(reasons).alias("reasons"))
    return tx.settle(rows, coverage=out).drop("_w", "_r", "_miss", "_k", "_loose", "_c")


def acceptance(df: DataFrame) -> DataFrame:
    """`df` (with ev, hard_fail and coverage) with `accept_reasons` and `accepted`."""
    e = F.col("ev")
    form = (e["scr"] == 100) & (e["tcr"] == 100) & (e["rma"] == 100)
    extra = F.array_compact(F.array(F.when(F.col("hard_fail"), "lexical_hard_fail"), F.when(~F.coalesce(form, F.lit(False)), "form_below_gate")))
    rows = df.withColumn("accept_reasons", F.concat(F.col("coverage")["reasons"], extra))
    return rows.withColumn("accepted", F.size("accept_reasons") == 0)
