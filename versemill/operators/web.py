"""From page lines to accepted and review windows; pasted groups to strict and review records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versemill.functions import text as tx
from versemill.operators.evaluate import evaluate
from versemill.operators.lexical import assess
from versemill.operators.lines import greedy
from versemill.plans.lineage import cut, drop


def fingerprint(text: Column) -> Column:
    """The digest under which windows count as the same: NFC, no carriage returns, stripped, lower case."""
    return F.sha2(F.lower(tx.strip(F.translate(tx.nfc(text), "\r", ""))), 256)


def judged(windows: DataFrame, text: str = "window", min_rma: float = 50.0, min_tcr: float = 70.0) -> DataFrame:
    """(…, ev, hard_fail, bucket, review_reason): windows that are well-formed and without lexical errors,
    accepted if rhyme and tone are good enough, else for review with the reasons."""
    rows = assess(evaluate(windows, text, 4), text).where(F.col("ev.structure_ok") & ~F.col("hard_fail"))
    low = F.array_compact(F.array(F.when(F.col("ev.rma") < min_rma, "low_rhyme_score"), F.when(F.col("ev.tcr") < min_tcr, "low_tone_score")))
    return rows.withColumn("review_reason", F.array_join(low, ",")).withColumn("bucket", F.when(F.col("review_reason") == "", "accepted").otherwise("review"))


def select_windows(windows: DataFrame, page: str = "id", pos: str = "pos", text: str = "window") -> DataFrame:
    """(page, pos, fingerprint, bucket, review_reason): what is kept of all windows of all pages.

    A window that repeats one of its page is dropped before it is judged. Of the judged ones each page
    keeps the first that do not overlap. Over all pages the first of a fingerprint stays; a review
    window goes if it was accepted on an earlier page, or earlier on its own.
    """
    rows = windows.withColumn("fingerprint", fingerprint(F.col(text)))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(page, "fingerprint").orderBy(pos))).where("_n = 1").drop("_n")
    rows = judged(first, text)
    kept = rows.groupBy(page).agg(greedy(F.collect_list(F.col(pos).cast("int"))).alias("k")).select(page, F.explode("k").alias(pos))
    rows = rows.join(kept, [page, pos]).select(page, pos, "fingerprint", "bucket", "review_reason")
    seen = Window.partitionBy("fingerprint", "bucket").orderBy(page, pos)
    rows = rows.withColumn("_n", F.row_number().over(seen)).where("_n = 1").drop("_n")
    accepted = rows.where("bucket = 'accepted'").select("fingerprint", F.col(page).alias("_p"))
    rows = rows.join(accepted, "fingerprint", "left")
    return rows.where((F.col("bucket") == "accepted") | F.col("_p").isNull() | (F.col("_p") > F.col(page))).drop("_p")


def page_audit(lines: DataFrame, windows: DataFrame, kept: DataFrame, page: str = "id") -> DataFrame:
    """(page, rendered_lines, scanned_windows, accepted, review) of every page."""
    of = lambda b: F.sum(F.when(F.col("bucket") == b, 1).otherwise(0)).alias(b)
    rows = lines.groupBy(page).agg(F.count("*").alias("rendered_lines"))
    rows = rows.join(windows.groupBy(page).agg(F.count("*").alias("scanned_windows")), page, "left")
    return rows.join(kept.groupBy(page).agg(of("accepted"), of("review")), page, "left").fillna(0)


def paired_selections(left: DataFrame, right: DataFrame, key: str, must_match: list[str]) -> DataFrame:
    """Two tables joined one to one. A key that only one has, or columns that differ, fail the job."""
    a = left.withColumn("_a", F.lit(True))
    b = right.select(key, F.lit(True).alias("_b"), *[F.col(c).alias(f"{c}_b") for c in right.columns if c != key])
    both = a.join(b, key, "full_outer")
    wrong = F.col("_a").isNull() | F.col("_b").isNull()
    for c in must_match:
        wrong = wrong | ~F.col(c).eqNullSafe(F.col(f"{c}_b"))
    return both.withColumn("_ok", F.when(wrong, F.raise_error(F.concat(F.lit("no match for "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).where("_ok").drop("_a", "_b", "_ok")


def in_both(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that two sets share and should not: manifests, or clusters of train and dev."""
    return a.select(*columns).intersect(b.select(*columns))


def chosen(df: DataFrame, wanted: list, key: str) -> DataFrame:
    """The wanted keys in the order given, with `ord`; repeated or missing ones raise."""
    if len(set(wanted)) != len(wanted):
        raise ValueError("a key is wanted twice")
    kind = df.schema[key].dataType.simpleString()
    asked = df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(wanted)], f"`{key}` {kind}, ord int")
    rows = asked.join(df, key, "left_anti")
    if missing := [r[0] for r in rows.select(key).limit(20).collect()]:
        raise ValueError(f"missing: {missing}")
    return df.join(asked, key)


def crawl_totals(pages: DataFrame) -> DataFrame:
    """(pages, rendered_lines, scanned_windows, accepted, review, empty_pages): the totals of a page_audit()."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("rendered_lines", "scanned_windows", "accepted", "review")]
    return pages.agg(F.count("*").alias("pages"), *sums, F.count_if(F.col("accepted") + F.col("review") == 0).alias("empty_pages"))


def _folded(known: Column) -> Column:
    """taken, overlaps and repeats of one group: a fold over its sound windows in order of pos.

    A window that overlaps the last one taken goes first; then one whose digest was taken in this group,
    or in an earlier one (`known`), which leaves its lines free.
    """
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<string>").alias("seen"), none.alias("taken"), none.alias("overlaps"), none.alias("repeats"))

    def step(s: Column, x: Column) -> Column:
        changed = lambda **new: F.struct(*[new.get(f, s[f]).alias(f) for f in ("last", "seen", "taken", "overlaps", "repeats")])
        at, digest = x["pos"], x["digest"]
        more = lambda f: F.concat(s[f], F.array(at))
        again = F.array_contains(s["seen"], digest) | F.coalesce(F.array_contains(known, digest), F.lit(False))
        return F.when(s["last"].isNotNull() & (at < s["last"] + 4), changed(overlaps=more("overlaps"))).when(again, changed(repeats=more("repeats"))).otherwise(changed(last=at, seen=F.concat(s["seen"], F.array(digest)), taken=more("taken")))

    return F.aggregate("windows", start, step)


def fold_groups(windows: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(grp, pos, digest, state) of sound windows (grp, pos, digest): "taken", "overlap" or "repeat", as one pass over all
    groups in order would have it.

    Groups are folded by themselves; then each learns which of its digests an earlier group has taken, and those
    that learn something new are folded again, until none does. After k rounds the first k groups are as
    in the single pass, and mostly all of them are after two or three. Groups are as long as a page, not as the corpus.
    """
    struct = F.sort_array(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "digest")))
    groups = cut(windows.groupBy("grp").agg(struct.alias("windows")), "groups")
    state, before = None, None
    for _ in range(max_rounds):
        if state is None:
            rows = groups.withColumn("known", F.array().cast("array<string>"))
        else:
            taken = state.select("grp", F.explode(F.filter("windows", lambda x: F.array_contains(F.col("f.taken"), x["pos"]))["digest"]).alias("digest")).groupBy("digest").agg(F.min("grp").alias("first"))
            held = groups.select("grp", F.explode(F.array_distinct(F.col("windows")["digest"])).alias("digest"))
            known = held.join(taken, "digest").where(F.col("first") < F.col("grp")).groupBy("grp").agg(F.sort_array(F.collect_list("digest")).alias("known"))
            rows = groups.join(known, "grp", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
        now = cut(rows.withColumn("f", _folded(F.col("known"))), "folded")
        seen = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("grp", "known")), F.bit_xor(F.xxhash64(F.lit(2), "grp", "known"))).first())
        if state is not None:
            drop(state)
        state = now
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"groups did not settle in {max_rounds} rounds")
    at = F.col("x.pos")
    named = F.when(F.array_contains("f.taken", at), "taken").when(F.array_contains("f.repeats", at), "repeat").otherwise("overlap")
    return state.select("grp", "f", F.explode("windows").alias("x")).select("grp", at.alias("pos"), F.col("x.digest").alias("digest"), named.alias("state"))


def manual_import(groups: DataFrame, min_rma: float = 50.0, min_tcr: float = 70.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records(grp, pos, text, digest, bucket, review_reason), short(grp, text), audit) of pasted groups (grp, lines), taken
    in the order of grp.

    Every four neighbouring lines are a window. Windows without the form, with certain lexical errors, that overlap
    a window taken from their group, or that repeat any taken before go, in this order. What stays is `strict` if tone and
    rhyme are good enough, else for `review`. Groups of two lines are kept apart as short units. The audit has one row.
    """
    rows = cut(groups.select("grp", "lines", F.size("lines").alias("n")), "pasted")
    spots = F.sequence(F.lit(0), F.col("n") - 4)
    windows = rows.where("n >= 4").select("grp", "lines", F.explode(spots).alias("pos")).select("grp", "pos", F.array_join(F.slice("lines", F.col("pos") + 1, F.lit(4)), "\n").alias("text"))
    scored = assess(evaluate(windows, "text", 4), "text").select("grp", "pos", "text", "hard_fail", F.col("ev.structure_ok").alias("sound"), F.col("ev.tcr").alias("tcr"), F.col("ev.rma").alias("rma"))
    scored = cut(scored.withColumn("digest", F.sha2(F.lower(tx.nfc(F.col("text"))), 256)), "scored")
    folded = cut(fold_groups(scored.where("sound AND NOT hard_fail").select("grp", "pos", "digest")), "fold")
    taken = scored.join(folded.where("state = 'taken'").select("grp", "pos"), ["grp", "pos"])
    good = (F.col("tcr") >= min_tcr) & (F.col("rma") >= min_rma)
    reason = F.when(~good, F.when(F.col("rma") < min_rma, "low_rhyme_score").otherwise("low_tone_score"))
    records = cut(taken.select("grp", "pos", "text", "digest", F.when(good, "strict").otherwise("review").alias("bucket"), reason.alias("review_reason")), "records")
    audit = rows.agg(F.count("*").alias("source_groups"), F.count_if(F.col("n") == 2).alias("two_line_units"), F.count_if(F.col("n") < 4).alias("under_four_lines"))
    one = [
        scored.agg(F.count("*").alias("windows_scanned"), F.count_if("sound").alias("structure_ok_windows"), F.count_if(F.col("sound") & F.col("hard_fail")).alias("lexical_rejected")),
        folded.agg(F.count_if(F.col("state") == "overlap").alias("overlap_rejected"), F.count_if(F.col("state") == "repeat").alias("exact_duplicates")),
        records.agg(F.count_if(F.col("bucket") == "strict").alias("strict_records"), F.count_if(F.col("bucket") == "review").alias("review_records")),
    ]
    for part in one:
        audit = audit.join(F.broadcast(part))
    return records, rows.where("n = 2").select("grp", F.array_join("lines", "\n").alias("text")), audit
