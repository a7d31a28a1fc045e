"""Scores, gates and traces of poems: array functions over one row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.functions import phonetics as ph
from versemill.functions import tables as T
from versemill.functions import text as tx


def let(value: Column, body) -> Column:
    """`body(value)` with the value worked out once; inside array functions nothing else shares it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sounds(words: Column) -> Column:
    """The length of a line, the tones at its places 2, 4, 6 and 8, and the rhymes at 6 and 8."""
    at = lambda k: F.coalesce(F.get(words, F.lit(k - 1)), F.lit(""))
    tones = F.transform(F.array(*[at(k) for k in (2, 4, 6, 8)]), lambda w: let(F.regexp_extract(w, f"[{T.TONAL}]", 0), lambda m: ph.tone_of_mark(w, m)))
    rhymes = F.transform(F.array(at(6), at(8)), lambda w: let(F.regexp_replace(ph.detoned(w), "^(" + "|".join(T.ONSETS) + ")", ""), ph.without_glide))
    return F.struct(F.size(words).alias("n"), tones.alias("t"), rhymes.alias("r"))


def _line(sounds: Column) -> Column:
    """How many mandatory places a line has, and how many are right."""
    n, t = sounds["n"], sounds["t"]
    yes = lambda c: c.cast("int")
    first = yes(t[0].isin(*T.BANG)) + yes(t[1].isin(*T.TRAC)) + yes(t[2].isin(*T.BANG))
    last = F.when(t[2] == "huyền", t[3] == "ngang").when(t[2] == "ngang", t[3] == "huyền").otherwise(t[3].isin(*T.BANG))
    return F.struct(
        n.alias("n"),
        F.when(n == 6, first).when(n == 8, first + yes(last)).otherwise(0).alias("correct"),
        F.when(n == 6, 3).when(n == 8, 4).otherwise(0).alias("mandatory"),
        sounds["r"].alias("r"),
    )


def evaluate(df: DataFrame, text: str = "text", expected: Column | int | None = None, out: str = "ev") -> DataFrame:
    """`df` with the struct `out`: structure, tone and rhyme scores of each poem, their weighted sum, validity.

    Lines without words do not count. With `expected`, missing and surplus lines cost slots. Rhyme is
    asked only of well-formed poems. Scores are rounded half-even to two places; sums and validity use
    the exact ones. A null text gives a null struct, an empty one scores 0. A non-positive `expected`
    fails the job.
    """
    if isinstance(expected, int) and expected <= 0:
        raise ValueError("expected must be positive")
    ex = F.lit(expected).cast("int") if expected is None or isinstance(expected, int) else expected.cast("int")
    ex = F.when(ex <= 0, F.raise_error(F.lit("expected must be positive")).cast("int")).otherwise(ex)
    rows = tx.settle(df, _l=F.transform(tx.line_tokens(tx.nfc(F.col(text))), _sounds), _x=ex)
    rows = tx.settle(rows, _l=F.transform("_l", _line))
    x, n = F.col("_x"), F.size("_l")
    total = lambda f: F.aggregate("_l", F.lit(0), lambda s, l: s + l[f])
    want = lambda i: F.when(i % 2 == 0, 6).otherwise(8)
    fits = lambda l, i: (x.isNull() | (i < x)) & ~(x.isNull() & (n % 2 == 1) & (i == n - 1)) & (l["n"] == want(i))
    rows = tx.settle(rows, _ok=F.transform("_l", fits))
    bad = F.filter(F.transform("_ok", lambda ok, i: F.when(~ok, F.format_string("line_%d_expected_%d", i + 1, want(i)))), lambda e: e.isNotNull())
    counts = F.array(
        F.when(n % 2 == 1, "incomplete_couplet"),
        F.when(x.isNotNull() & (n != x), "line_count_mismatch"),
        F.when(x.isNotNull() & (x % 2 == 1), "odd_expected_num_lines"),
    )
    rows = tx.settle(rows, _e=F.when(n == 0, F.array(F.lit("empty_poem"))).otherwise(F.concat(F.array_compact(counts), bad)))
    rows = rows.withColumn("_s", F.size("_e") == 0)
    pairs = F.transform(F.slice("_l", F.lit(1), F.greatest(n - 1, F.lit(0))), lambda l, i: F.struct(l["r"][i % 2].alias("a"), F.col("_l")[i + 1]["r"][0].alias("b")))
    rows = tx.settle(rows, _p=pairs)
    kinds = F.transform("_p", lambda p: F.coalesce(ph.rhyme_kind_extracted(p["a"], p["b"]), F.lit("mismatch")))
    rows = tx.settle(rows, _k=F.when(F.col("_s") & (n >= 2), kinds).otherwise(F.array().cast("array<string>")))
    share = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(F.lit(100.0) * a, b))
    of = lambda k: share(F.size(F.filter("_k", lambda v: v == k)), F.size("_k"))
    slots = F.when(n == 0, F.coalesce(x, F.lit(0))).otherwise(F.greatest(n, F.coalesce(x, n)))
    rows = tx.settle(rows, _m=F.struct(share(F.size(F.filter("_ok", lambda v: v)), slots).alias("scr"), share(total("correct"), total("mandatory")).alias("tcr"), of("exact").alias("exact"), of("slant").alias("slant")))
    m = F.col("_m")
    rma = m["exact"] + m["slant"]
    weights = T.METRIC_WEIGHTS
    overall = weights["scr"] * m["scr"] + weights["tcr"] * m["tcr"] + weights["rma"] * rma
    two = lambda c, name: F.bround(c, 2).alias(name)
    scores = F.struct(
        two(m["scr"], "scr"), two(m["tcr"], "tcr"), two(m["exact"], "exact_rma"), two(m["slant"], "slant_rma"), two(rma, "rma"), two(overall, "overall"),
        (F.col("_s") & (m["scr"] == 100) & (m["tcr"] == 100) & (rma == 100)).alias("is_valid"),
        F.col("_s").alias("structure_ok"), F.col("_e").alias("errors"), n.alias("num_lines"), F.col("_k").alias("rhyme_kinds"),
    )
    return tx.settle(rows, **{out: F.when(F.col(text).isNotNull(), scores)}).drop("_l", "_x", "_ok", "_e", "_s", "_p", "_k", "_m")


def longest_run(tokens: Column) -> Column:
    """The length of the longest run of equal neighbours; a fold."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, t: Column) -> Column:
        run = F.when(s["last"] == t, s["run"] + 1).otherwise(1)
        return F.struct(t.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(tokens, start, step, lambda s: s["best"])


def quality_reasons(df: DataFrame, text: str = "text", ev: str = "ev", min_tcr: float = 95.0, min_rma: float = 90.0, max_run: int = 3) -> DataFrame:
    """`df` with `reasons`: why a poem is not of training quality, in fixed order; empty for a good one."""
    stripped = F.filter(F.transform(tx.any_lines(F.col(text)), lambda x: F.lower(tx.strip(x))), lambda x: x != "")
    repeated = F.size(stripped) != F.size(F.array_distinct(stripped))
    run = longest_run(F.regexp_extract_all(F.lower(text), F.lit(T.WORD_ANY), F.lit(0))) > max_run
    e = F.col(ev)
    checks = [(~e["structure_ok"], "structure"), (e["tcr"] < min_tcr, "tone"), (e["rma"] < min_rma, "rhyme"), (repeated, "repeated_line"), (run, "repeated_token_run")]
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(c, name) for c, name in checks])))


def prosody_trace(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(id, i, syllable, tone, rhyme, line_type, place, required_tone, required_rhyme) of every syllable.

    Line breaks do not matter: the state after i syllables depends on i mod 14 and on the syllables two
    and six places back, so the automaton is read off by offset instead of being run.
    """
    flat = F.flatten(tx.line_tokens(tx.nfc(F.col(text))))
    rows = tx.settle(df.select(F.col(key).alias("id"), F.col(text)), t=flat)
    near = F.transform("t", lambda w, i: F.struct(w.alias("w"), F.get("t", i - 2).alias("two"), F.get("t", i - 6).alias("six")))
    rows = rows.select("id", F.posexplode(near).alias("i", "n")).select("id", "i", F.col("n.w").alias("syllable"), F.col("n.two").alias("two"), F.col("n.six").alias("six"))
    p = F.col("i") % 14
    two_back = ph.tone(F.col("two"))
    return rows.select(
        "id",
        "i",
        "syllable",
        ph.tone(F.col("syllable")).alias("tone"),
        ph.rhyme(F.col("syllable")).alias("rhyme"),
        F.when(p < 6, "luc").otherwise("bat").alias("line_type"),
        F.when(p < 6, p + 1).otherwise(p - 5).alias("place"),
        F.when(p.isin(1, 5, 7, 11), "B").when(p.isin(3, 9), "T").when(p == 13, F.when(two_back == "ngang", "HUYEN").when(two_back == "huyền", "NGANG").otherwise("B")).alias("required_tone"),
        F.when(p.isin(5, 11) & (F.col("i") >= 6), ph.rhyme(F.col("six"))).alias("required_rhyme"),
    )


def scaffold_verdict(anchors: list[Column]) -> Column:
    """The first reason against five rhyme anchors (in the order of SCAFFOLD_KEYS), null if there is none.

    A null anchor is a missing key. Each must be one syllable, all bằng, the two of line 2 of different
    bằng tones, and three pairs must rhyme.
    """
    words = [tx.tokens(tx.nfc(a)) for a in anchors]
    syllables = [F.get(w, F.lit(0)) for w in words]
    names = T.SCAFFOLD_KEYS
    reason = F.when(F.greatest(*[a.isNull().cast("int") for a in anchors]) == 1, "invalid_scaffold_schema")
    for name, w in zip(names, words):
        reason = reason.when(F.size(w) != 1, f"{name}_must_be_one_syllable")
    flat = F.array_compact(F.array(*[F.when(~ph.is_bang(s), name) for s, name in zip(syllables, names)]))
    reason = reason.when(F.size(flat) > 0, F.concat(F.lit("anchor_not_bang:"), F.array_join(flat, ",")))
    six, end = ph.tone(syllables[1]), ph.tone(syllables[2])
    reason = reason.when(((six == "huyền") & (end != "ngang")) | ((six == "ngang") & (end != "huyền")), "line_2_bang_pair_must_alternate")
    pairs = [(0, 1), (2, 3), (3, 4)]
    apart = F.array_compact(F.array(*[F.when(ph.rhyme_kind(syllables[a], syllables[b]).isNull(), f"{names[a]}:{names[b]}") for a, b in pairs]))
    return reason.when(F.size(apart) > 0, F.concat(F.lit("rhyme_mismatch:"), F.array_join(apart, ",")))


def resolve_scaffold(df: DataFrame, anchors: list[str]) -> DataFrame:
    """`df` with `scaffold_source`, `scaffold` and `scaffold_reason`: the proposal, or the fixed anchors."""
    rows = df.withColumn("scaffold_reason", scaffold_verdict([F.col(a) for a in anchors]))
    own = F.array(*[F.get(tx.tokens(tx.nfc(F.col(a))), F.lit(0)) for a in anchors])
    fixed = F.array(*[F.lit(x) for x in T.DEFAULT_SCAFFOLD])
    good = F.col("scaffold_reason").isNull()
    return rows.withColumn("scaffold_source", F.when(good, "validated").otherwise("fallback")).withColumn("scaffold", F.when(good, own).otherwise(fixed))
