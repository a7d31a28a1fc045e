"""What a constrained decoder would allow at each token of a sequence, by joins instead of by stepping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versemill.functions import phonetics as ph

TONE_PENALTY, RHYME_PENALTY = 1.5, 3.0
SEP = "\x01"


def steps(sequences: DataFrame) -> DataFrame:
    """(id, i, token, syllable_no, root, before, syllable): the state before each token of (id, tokens).

    A blank or a line end begins a new syllable; `before` is the path walked within it, from the root of
    line starts (0) or of mid-line syllables (1).
    """
    rows = sequences.select("id", F.posexplode("tokens").alias("i", "token"))
    w = Window.partitionBy("id").orderBy("i")
    cut = F.col("token").isin(" ", "\n")
    rows = rows.withColumn("g", F.sum(cut.cast("int")).over(w))
    rows = rows.withColumn("head", F.first("token").over(Window.partitionBy("id", "g").orderBy("i")))
    own = Window.partitionBy("id", "g").orderBy("i")
    rows = rows.withColumn("walked", F.array_join(F.filter(F.collect_list("token").over(own), lambda t: t != "\n"), SEP))
    whole = F.array_join(F.collect_list(F.when(~cut, F.col("token"))).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "")
    rows = rows.withColumn("syllable", whole).withColumn("root", F.when(F.col("head") == " ", 1).otherwise(0))
    return rows.select("id", "i", "token", F.col("g").alias("syllable_no"), "root", "walked", "syllable", F.lag("walked").over(w).alias("before"), F.lag("root").over(w).alias("before_root"))


def traced(sequences: DataFrame, trie: DataFrame) -> DataFrame:
    """(id, i, token, allowed, penalty) for each token.

    A token is allowed if the path with it is a node of the trie; a blank or line end if the syllable
    before is complete. After the sixth syllable of a six-word line and the eighth of an eight-word line
    only a line end may follow, and nowhere else. The first token of a syllable costs a penalty if the
    syllable misses the tone or the rhyme that its place asks for.
    """
    rows = steps(sequences)
    nodes = trie.select("root", F.col("path").alias("walked"), F.lit(True).alias("node"))
    ends = trie.where("complete").select(F.col("root").alias("before_root"), F.col("path").alias("before"), F.lit(True).alias("ended"))
    rows = rows.join(nodes, ["root", "walked"], "left").join(ends, ["before_root", "before"], "left")
    p = (F.col("syllable_no") % 14).cast("int")
    starts = F.col("token").isin(" ", "\n")
    line_end = p.isin(6, 0) & (F.col("syllable_no") > 0)
    walk = F.coalesce("node", F.lit(False)) | (F.col("token") == "\n")
    done = ~starts | F.coalesce("ended", F.lit(False))
    fits = F.when(F.col("token") == "\n", line_end).when(F.col("token") == " ", ~line_end).otherwise(True)
    rows = rows.withColumn("allowed", walk & done & fits)
    per = rows.select("id", "syllable_no", "syllable").distinct()
    w = Window.partitionBy("id").orderBy("syllable_no")
    back = lambda k: F.lag("syllable", k).over(w)
    per = per.withColumn("b2", back(2)).withColumn("b6", back(6)).withColumn("p", (F.col("syllable_no") % 14).cast("int"))
    tone, two = ph.tone(F.col("syllable")), ph.tone(F.col("b2"))
    wrong = (
        F.when(F.col("p").isin(1, 5, 7, 11), ~tone.isin("ngang", "huyền"))
        .when(F.col("p").isin(3, 9), tone.isin("ngang", "huyền"))
        .when(F.col("p") == 13, F.when(two == "ngang", tone != "huyền").when(two == "huyền", tone != "ngang").otherwise(~tone.isin("ngang", "huyền")))
    )
    off = F.when(F.col("p").isin(5, 11) & F.col("b6").isNotNull(), ph.rhyme_kind(F.col("b6"), F.col("syllable")).isNull())
    cost = F.when(F.coalesce(wrong, F.lit(False)), TONE_PENALTY).otherwise(0.0) + F.when(F.coalesce(off, F.lit(False)), RHYME_PENALTY).otherwise(0.0)
    per = per.select("id", "syllable_no", cost.alias("cost"))
    first = F.row_number().over(Window.partitionBy("id", "syllable_no").orderBy("i")) == 1
    return rows.withColumn("first", first).join(per, ["id", "syllable_no"]).select("id", "i", "token", "allowed", F.when(F.col("first"), F.col("cost")).otherwise(0.0).alias("penalty"))


def next_tokens(states: DataFrame, trie: DataFrame) -> DataFrame:
    """(state, token): what the trie lets follow each state (state, root, path): children of the node, and
    the first tokens of mid-line syllables where the node is complete. The empty path is a root."""
    parent = F.when(F.instr("path", SEP) > 0, F.expr("left(path, length(path) - length(token) - 1)")).otherwise("")
    children = trie.select("root", parent.alias("path"), "token")
    full = states.join(trie.where("complete").select("root", "path"), ["root", "path"], "left_semi")
    begin = full.select("state", F.lit(1).alias("root"), F.lit("").alias("path"))
    every = states.select("state", "root", "path").union(begin)
    return every.join(children, ["root", "path"]).select("state", "token").distinct()


def retry_penalty(attempt: Column) -> Column:
    """The rhyme penalty of an attempt, growing by half of itself each time."""
    return F.lit(RHYME_PENALTY) * (1 + 0.5 * (attempt - 1))


def strict_attempt(attempt: Column) -> Column:
    """Whether an attempt must keep tone and rhyme: from the second on."""
    return attempt >= 2


ALL_TONES = 7


def allowed_set(states: DataFrame, trie: DataFrame, masks: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """(state, token, kind, relaxed, penalty): the tokens that each state of a decoder allows.

    A state has root and path (the empty path is a root), line ("luc" or "bat"), word_pos, couplets, stop (null for
    none), finished, after_bat, and for the syllable under way and the next one the tones allowed (tones, next_tones, bits
    as in the trie) and the rhyme groups wanted (groups, next_groups, null for any).

    A finished state, and one with enough couplets, allows the end only (kind "end"); a complete syllable at the
    end of its line allows only a line end ("line"). Otherwise a syllable goes on ("walk") or, where it is complete, the
    next one begins ("begin"); after an eight-word line, at the start of the next, a decoder without a stop may also
    end. Strict states keep tokens below which the tones and groups can still be met; where none can, all
    stay and are marked as relaxed. Soft ones pay for the first token of a syllable that by `masks` is in no
    syllable of the tones or groups.
    """
    none = F.lit(None)
    full = states.join(trie.where("complete").select("root", "path", F.lit(True).alias("complete")), ["root", "path"], "left").withColumn("complete", F.coalesce("complete", F.lit(False)))
    closes = F.col("complete") & (((F.col("line") == "luc") & (F.col("word_pos") == 6)) | ((F.col("line") == "bat") & (F.col("word_pos") == 8)))
    forced = F.when(F.col("finished"), "end").when(closes, "line").when(F.col("couplets") >= F.col("stop"), "end")
    full = full.withColumn("forced", forced)
    free = full.where("forced IS NULL")
    only = full.where("forced IS NOT NULL").select("state", none.cast("string").alias("token"), F.col("forced").alias("kind"), F.lit(False).alias("relaxed"), F.lit(0.0).alias("penalty"))
    may_end = free.where((F.col("path") == "") & (F.col("root") == 0) & F.col("stop").isNull() & F.col("after_bat"))
    may_end = may_end.select("state", none.cast("string").alias("token"), F.lit("end").alias("kind"), F.lit(False).alias("relaxed"), F.lit(0.0).alias("penalty"))

    at_root = F.col("path") == ""
    walk = free.select("state", "root", "path", F.lit("walk").alias("kind"), F.col("tones").alias("t"), F.col("groups").alias("g"), at_root.alias("first"))
    begin = free.where("complete").select("state", F.lit(1).alias("root"), F.lit("").alias("path"), F.lit("begin").alias("kind"), F.col("next_tones").alias("t"), F.col("next_groups").alias("g"), F.lit(True).alias("first"))
    parent = F.when(F.instr("path", SEP) > 0, F.expr("left(path, length(path) - length(token) - 1)")).otherwise("")
    children = trie.select("root", parent.alias("path"), "token", "tone_bits", "gids")
    every = walk.union(begin).join(children, ["root", "path"])
    meets = lambda bits, gids: (bits.bitwiseAND(F.col("t")) != 0) & (F.col("g").isNull() | F.arrays_overlap(gids, F.col("g")))
    if strict:
        every = every.withColumn("ok", (F.col("t") == ALL_TONES) & F.col("g").isNull() | meets(F.col("tone_bits"), F.col("gids")))
        some = every.groupBy("state").agg(F.bool_or("ok").alias("some"))
        every = every.join(some, "state").where("ok OR NOT some").select("state", "token", "kind", (~F.col("some")).alias("relaxed"), F.lit(0.0).alias("penalty"))
        every = every.groupBy("state", "token").agg(F.max("kind").alias("kind"), F.max("relaxed").alias("relaxed"), F.min("penalty").alias("penalty"))
    else:
        every = every.join(masks.select("token", F.col("tone_bits").alias("mb"), F.col("gids").alias("mg")), "token", "left")
        wrong = F.when((F.col("t") != ALL_TONES) & (F.coalesce("mb", F.lit(0)).bitwiseAND(F.col("t")) == 0), TONE_PENALTY).otherwise(0.0)
        off = F.when(F.col("g").isNotNull() & ~F.coalesce(F.arrays_overlap("mg", "g"), F.lit(False)), RHYME_PENALTY).otherwise(0.0)
        every = every.select("state", "token", "kind", F.lit(False).alias("relaxed"), F.when(F.col("first"), wrong + off).otherwise(0.0).alias("penalty"))
        every = every.groupBy("state", "token").agg(F.max("kind").alias("kind"), F.max("relaxed").alias("relaxed"), F.max("penalty").alias("penalty"))
    return only.union(may_end).union(every.select("state", "token", "kind", "relaxed", "penalty"))


def token_texts(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """`tokens` (token) with `text`; tokens that the table of texts does not have are empty."""
    return tokens.join(texts, "token", "left").withColumn("text", F.coalesce("text", F.lit("")))
