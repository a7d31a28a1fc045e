"""The best representative of each group of duplicate records."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versemill.plans.lineage import cut

#: What stands in a field when nobody, or nothing, is named: a parameter of the functions below, this is its default.
NOBODY = [
    "", "-", "--", "?", "n/a", "na", "n.a", "n.a.", "null", "none", "nil", "nan", "undefined", "unknown", "anonymous",
    "anon", "khuyết danh", "ẩn danh", "vô danh", "nặc danh", "chưa rõ", "không rõ", "không rõ tác giả", "chưa rõ tác giả",
    "không có", "sưu tầm", "khuyet danh", "an danh", "vo danh", "khong ro", "chua ro",
]


def material_texts(texts: pa.Array) -> pa.Array:
    """NFC, lower case, outer white space removed."""
    return pa.array([None if x is None else unicodedata.normalize("NFC", x).lower().strip() for x in texts.to_pylist()], pa.string())


def _with_key(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, and `m`, the digest of the normalized text; equal texts have equal digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(0, "_text", material_texts(batch.column(0)))

    rows = df.mapInArrow(run, df.schema)
    return rows.select(F.sha2("_text", 256).alias("m"), *columns)


def named(author: Column, nobody: list[str] = NOBODY) -> Column:
    """True if an author names someone; brackets, case and blanks around do not matter."""
    bare = F.regexp_replace(F.lower(author), r"^[\s\p{Z}()\[\]<>\"'.:]+|[\s\p{Z}()\[\]<>\"':]+$", "")
    return F.coalesce(bare.rlike(r"[\p{L}\p{N}]") & ~bare.isin(nobody), F.lit(False))


def absolute(url: Column) -> Column:
    """True for an http or https address with a host."""
    return F.coalesce(url.rlike(r"^(?i)\s*https?://(?:[^\s/?#@]*@)?(?:[\p{L}\p{N}]|\[[0-9a-f:])[^\s]*\s*$"), F.lit(False))


def referenced(refs: Column) -> Column:
    """True if a reference has a source or an address that is not blank."""
    full = lambda c: F.coalesce(c.rlike(r"[^\s\p{Z}]"), F.lit(False))
    return F.coalesce(F.exists(refs, lambda r: full(r["source_id"]) | full(r["url"])), F.lit(False))


def best_representatives(df: DataFrame, trust: DataFrame, key: str = "rec_no", text: str = "text", nobody: list[str] = NOBODY) -> DataFrame:
    """(group_no, best_no, author_no, url_no) of each material that two or more rows hold.

    Rows hold the same material if their normalized texts are equal; null texts hold none, while
    empty ones are equal to each other. Rows are ranked by window order: for the best row by the
    number of usable fields among author, url and source_refs, then by preference (trust, recency,
    key); for author and url by preference among the usable ones, 0 if there is none. A row ranks
    once for each purpose it serves, and the planner limits every group to its first row before the
    shuffle, so a group of any size costs one row a task. Sources that are null or not listed are
    trusted least, a null date is earliest, and repeated rows count once each.
    """
    least = F.lit(-(2**31))
    trusted = trust.groupBy("source_id").agg(F.max("trust").cast("long").alias("_trust"))
    rows = df.where(F.col(text).isNotNull()).select(
        F.col(text).cast("string").alias("_text"),
        F.col(key).cast("long").alias("rec"),
        "source_id",
        F.unix_micros("ingested_at").alias("at"),
        named(F.col("author"), nobody).alias("author"),
        absolute(F.col("url")).alias("url"),
        referenced(F.col("source_refs")).alias("refs"),
    )
    rows = _with_key(rows, ["rec", "source_id", "at", "author", "url", "refs"]).join(trusted, "source_id", "left")
    usable = F.col("author").cast("int") + F.col("url").cast("int") + F.col("refs").cast("int")
    none = F.lit(None).cast("struct<kind:string,score:int>")
    purpose = lambda kind, ok, score: F.when(ok, F.struct(F.lit(kind).alias("kind"), score.alias("score"))).otherwise(none)
    purposes = F.array(
        purpose("best", F.lit(True), usable),
        purpose("author", F.col("author"), F.lit(0)),
        purpose("url", F.col("url"), F.lit(0)),
        purpose("first", F.lit(True), F.lit(0)),
    )
    each = rows.select("m", "rec", "at", F.coalesce("_trust", least).alias("trust"), F.explode(F.array_compact(purposes)).alias("p"))
    each = each.select("m", "rec", "at", "trust", "p.kind", "p.score")
    first = F.col("kind") == "first"
    order = [
        F.col("score").desc(),
        F.when(first, F.lit(0)).otherwise(F.col("trust")).desc(),
        F.when(first, F.lit(0)).otherwise(F.col("at")).desc_nulls_last(),
        F.col("rec").asc(),
    ]
    top = each.withColumn("rn", F.row_number().over(Window.partitionBy("m", "kind").orderBy(*order))).where("rn = 1")
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("rec")))
    held = rows.groupBy("m").agg(F.count("*").alias("held")).where("held > 1")
    chosen = top.groupBy("m").agg(of("first").alias("group_no"), of("best").alias("best_no"), of("author").alias("author_no"), of("url").alias("url_no"))
    zero = F.lit(0).cast("long")
    return chosen.join(held, "m").select("group_no", "best_no", F.coalesce("author_no", zero).alias("author_no"), F.coalesce("url_no", zero).alias("url_no"))


def references(df: DataFrame, key: str = "rec_no", text: str = "text") -> DataFrame:
    """(group_no, source_id, url, unit_type): the different usable references of all rows of each material that two or more
    rows hold, null and blank parts as they are. They stay rows, as a material may have any number of them."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(text).cast("string").alias("_text"), F.col(key).cast("long").alias("rec"), "source_refs")
    rows = cut(_with_key(rows, ["rec", "source_refs"]), "materials")
    groups = rows.groupBy("m").agg(F.min("rec").alias("group_no"), F.count("*").alias("held")).where("held > 1").select("m", "group_no")
    each = rows.select("m", F.explode("source_refs").alias("r")).where(referenced(F.array("r"))).select("m", "r.source_id", "r.url", "r.unit_type").distinct()
    return each.join(groups, "m").select("group_no", "source_id", "url", "unit_type")


def survivors(df: DataFrame, trust: DataFrame, key: str = "rec_no", text: str = "text", nobody: list[str] = NOBODY) -> DataFrame:
    """One built record for each material of two or more rows: the best row's text, source and category, author
    and url of the rows chosen for them, and the number of different references of all its rows (references() has them)."""
    chosen = cut(best_representatives(df, trust, key, text, nobody), "chosen")
    best = df.select(F.col(key).alias("best_no"), "source_id", "unit_type", text, "category")
    author = df.select(F.col(key).alias("author_no"), "author")
    url = df.select(F.col(key).alias("url_no"), "url")
    held = references(df, key, text).groupBy("group_no").agg(F.count("*").alias("n_refs"))
    out = chosen.join(best, "best_no").join(author, "author_no", "left").join(url, "url_no", "left").join(held, "group_no", "left")
    return out.withColumn("n_refs", F.coalesce("n_refs", F.lit(0).cast("long")))
