"""Reading corpora, reviews, word lists and pasted text into DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from versemill.functions import phonetics as ph
from versemill.functions import tables as T
from versemill.functions import text as tx
from versemill.plans.lineage import cut


def first_of(df: DataFrame, names: list[str]) -> str | None:
    """The first of the names that the table has, by its schema alone."""
    return next((n for n in names if n in df.columns), None)


def _poems(df: DataFrame, genres: list[str], genre: str, texts: list[str]) -> DataFrame:
    column, text = first_of(df, genres), first_of(df, texts) or df.columns[0]
    rows = df if column is None else df.where(F.lower(tx.strip(F.col(column))) == genre)
    return rows.select(F.col(text).cast("string").alias("text")).where("text IS NOT NULL")


def poems_parquet(spark: SparkSession, path: str) -> DataFrame:
    """(text) of the poems of the genre `luc_bat`; all poems if no column names a genre."""
    return _poems(spark.read.parquet(path), ["the_loai", "gender", "genre", "category"], "luc_bat", ["text"])


def poems_csv(spark: SparkSession, path: str) -> DataFrame:
    """(text) of the poems whose genre is exactly `lục bát`, not one that merely contains it."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return _poems(rows, ["gender", "the_loai", "genre", "category"], "lục bát", ["content", "text"])


def text_block(spark: SparkSession, path: str) -> DataFrame:
    """(text): each file as one block."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


def staging_csv(spark: SparkSession, path: str, genre: str = "luc bat", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows(id, title, url, text) of a genre, histogram(genre, n) of all genres).

    With `limit`, the first rows in file order, files by name, and the histogram ends with the last of them.
    """
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    named = rows.withColumn("_g", tx.squeeze(F.lower(tx.nfc(F.coalesce("genre", F.lit(""))))))
    if limit is not None:
        # a CSV with line ends in its values is one partition a file, whose rows are numbered in order
        named = named.withColumn("_file", F.input_file_name()).withColumn("_row", F.monotonically_increasing_id())
    kept = named.where(F.col("_g") == genre).withColumn("text", tx.staged(F.col("content"))).where("text <> ''")
    if limit is not None:
        kept = kept.orderBy("_file", "_row").limit(limit)
        last = kept.agg(F.max(F.struct("_file", "_row")).alias("last"), F.count("*").alias("kept"))
        named = named.join(F.broadcast(last)).where((F.col("kept") < limit) | (F.struct("_file", "_row") <= F.col("last")))
    return kept.select("id", "title", "url", "text"), named.groupBy(F.col("_g").alias("genre")).agg(F.count("*").alias("n"))


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank ones are skipped and broken ones fail the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON value a file; the elements of a list become rows."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def candidate_dump(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(prompt_id, prompt, idx, poem) of a dump of candidate pools, one document a file or one pool a line."""
    schema = "prompt_id string, prompt string, candidates array<struct<poem:string>>"
    rows = json_document(spark, path, schema) if multi_line else jsonl(spark, path, schema)
    return rows.select("prompt_id", "prompt", F.posexplode("candidates").alias("idx", "c")).select("prompt_id", "prompt", "idx", F.col("c.poem").alias("poem"))


def review_csv(spark: SparkSession, path: str, headers: tuple[str, ...] = ("decision_accept_reject", "modecision_accept_reject")) -> DataFrame:
    """A review sheet with `decision`, from either of two headers; a byte order mark does not matter.

    Fails if neither is there, and for a row in which the two contradict each other.
    """
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    found = [h for h in headers if h in rows.columns]
    if not found:
        raise ValueError(f"none of {headers} in {path}")
    values = F.array_distinct(F.array_compact(F.array(*[F.when(tx.strip(F.col(h)) != "", F.upper(tx.squeeze(F.col(h)))) for h in found])))
    one = F.when(F.size(values) > 1, F.raise_error(F.lit("two columns contradict each other")).cast("string")).otherwise(F.get(values, F.lit(0)))
    return rows.withColumn("decision", F.coalesce(one, F.lit("")))


def phrase_list(spark: SparkSession, path: str, most: int = 10_000) -> list[str]:
    """The phrases of a lexicon file, without comments and blank lines; longer files than `most` are refused."""
    rows = spark.read.text(path).select(tx.strip(F.col("value")).alias("p")).where("p <> '' AND NOT p LIKE '#%'")
    found = [r.p for r in rows.limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} phrases")
    return found


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, line): the lines of each text file with their places, by line ends of any kind."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", T.LINE_END)).alias("ord", "line"))


def _sessions(rows: DataFrame, cut: Column, keep: Column, carried: dict[str, Column], needs: str | None) -> DataFrame:
    """Groups of kept lines between boundaries, with what was last said of each; files are independent."""
    w = Window.partitionBy("file").orderBy("ord")
    rows = rows.withColumn("_b", cut)
    for name, value in carried.items():
        rows = rows.withColumn(name, F.last(value, ignorenulls=True).over(w))
    rows = rows.withColumn("_g", F.sum(F.col("_b").cast("int")).over(w)).where(keep)
    if needs:
        rows = rows.where(F.col(needs).isNotNull() & (F.col(needs) != ""))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"])
    blank = lambda n: F.when(F.max(n) != "", F.max(n)).alias(n)
    return rows.groupBy("file", "_g").agg(*[blank(n) for n in carried], F.min("ord").alias("ord"), lines.alias("lines")).drop("_g")


# How the parts of pasted poems are told apart. An address is followed by the word for "source" on
# pages that were pasted without a line end, whose letters therefore go from its end.
PASTED = {
    "quotes": '^[“”"]+|[“”"]+$',
    "labeled_url": r"(?iu)^nguồn\s*:\s*(https?://\S+)",
    "item": r"(?iu)^(?:bài(?:\s+thơ)?\s*)?(\d+)\.?\s*$",
    "category": r"(?iu)^thơ\s+chúc\s+tết([^\p{L}\p{N}_]|$)",
    "title": "bài thơ chúc tết",
    "number": r"^\d+[.)]\s*",
    "url": r"(?iu)nguồn\s*:\s*(https?://\S+)",
    "url_end": "[Nguồn]+$",
    "author": "tác giả:",
    "boundary": r"(?iu)^(?:nguồn\s*:|bài\s*\d+\s*:|tác giả\s*:|[-─—]{3,}|khám phá thêm)",
    "noise": r"(?iu)^(?:thơ mới|nhạc đông nam á|người đông nam á)",
}


def labeled_paste(rows: DataFrame) -> DataFrame:
    """(file, url, category, label, ord, lines) of pasted poems from (file, ord, line).

    A source address, a blank or dashed line, a category, an item number and a title each end a poem. An
    address starts over without category and label, a category without label. Nothing before the first
    address counts.
    """
    line = F.regexp_replace(tx.strip(F.regexp_replace(tx.nfc(F.col("line")), "﻿", "")), PASTED["quotes"], "")
    rows = rows.select("file", "ord", line.alias("line"))
    x, low = F.col("line"), F.lower("line")
    url = F.regexp_extract(x, PASTED["labeled_url"], 1)
    item = F.regexp_extract(x, PASTED["item"], 1)
    is_url, blank = url != "", (x == "") | x.rlike("^-+$")
    category = ~is_url & ~blank & x.rlike(PASTED["category"])
    numbered = ~is_url & ~blank & ~category & (item != "")
    title = ~is_url & ~blank & ~category & ~numbered & low.startswith(PASTED["title"])
    carried = {
        "url": F.when(is_url, url),
        "category": F.when(is_url, "").when(category, x),
        "label": F.when(is_url | category, "").when(numbered, F.concat(F.lit("Bài "), item)).when(title, x),
    }
    ends = is_url | blank | category | numbered | title
    return _sessions(rows, ends, ~F.col("_b"), carried, "url")


def manual_paste(rows: DataFrame) -> DataFrame:
    """(file, url, author, ord, lines) of pasted groups from (file, ord, line).

    Addresses, authors, boundaries and noise end a group, blank lines do not; numbers before a line go.
    """
    line = F.regexp_replace(tx.strip(F.regexp_replace(tx.nfc(F.col("line")), "[​﻿]", "")), PASTED["number"], "")
    rows = rows.select("file", "ord", line.alias("line"))
    x, low = F.col("line"), F.lower("line")
    url = F.regexp_replace(F.regexp_extract(x, PASTED["url"], 1), PASTED["url_end"], "")
    is_url = url != ""
    author = ~is_url & low.startswith(PASTED["author"])
    bound = ~is_url & ~author & (x.rlike(PASTED["boundary"]) | x.rlike(PASTED["noise"]))
    named = tx.strip(F.regexp_replace(x, "^[^:]*:", ""))
    carried = {"url": F.when(is_url, url), "author": F.when(is_url, "").when(author, named)}
    out = _sessions(rows, is_url | author | bound, ~F.col("_b") & (F.col("line") != ""), carried, None)
    return out.withColumn("url", F.coalesce("url", F.lit("manual:unknown")))


def vocabulary_attributes(df: DataFrame, token: str = "token") -> DataFrame:
    """`df` with tone, tone bit, rhyme and validity of each token, blanks around it aside."""
    w = tx.normalize_text(F.col(token))
    rows = tx.settle(df, _w=w)
    c = F.col("_w")
    return rows.select("*", ph.tone(c).alias("tone"), ph.tone_bit(c).alias("tone_bit"), ph.rhyme(c).alias("rhyme"), ph.is_syllable(c).alias("valid")).drop("_w")


def fetchable(content_type: Column, size: Column, most: int = 3_000_000) -> Column:
    """True for pages of an allowed type that are not too long."""
    return content_type.isin("text/html", "application/xhtml+xml") & (size <= most)


def with_host(pages: DataFrame, url: str = "url") -> DataFrame:
    """`pages` with `host` in lower case and `path` ("/" at least) of each address; both empty unless it is http or https."""
    x = tx.strip(F.col(url))
    host = F.regexp_extract(F.lower(x), "^https?://([^/?#:]+)", 1)
    path = F.regexp_extract(x, "^[a-zA-Z]+://[^/?#]*(/[^?#]*)", 1)
    return pages.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.when(host == "", "").otherwise(F.when(path == "", "/").otherwise(path)))


def robots_rules(files: DataFrame, agent: str = "*") -> DataFrame:
    """(host, prefix, allow) of robots files (host, robots) for an agent, or for all agents where none is named.

    A run of agent lines heads the rules up to the next run; comments and unknown lines do not count, and a
    rule without a path forbids nothing.
    """
    line = tx.strip(F.regexp_replace("line", "#.*$", ""))
    rows = files.select("host", F.posexplode(F.split("robots", T.LINE_END)).alias("at", "line")).select("host", "at", line.alias("line"))
    field, value = F.lower(tx.strip(F.substring_index("line", ":", 1))), tx.strip(F.expr("substr(line, instr(line, ':') + 1)"))
    rows = rows.where(F.instr("line", ":") > 0).select("host", "at", field.alias("field"), value.alias("value")).where(F.col("field").isin("user-agent", "allow", "disallow"))
    w = Window.partitionBy("host").orderBy("at")
    heads = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    rows = rows.withColumn("_new", heads.cast("int")).withColumn("section", F.sum("_new").over(w))
    named = F.lower("value").isin(agent.lower(), "*")
    mine = rows.where(F.col("field") == "user-agent").groupBy("host", "section").agg(F.bool_or(named).alias("mine")).where("mine")
    rules = rows.where("field <> 'user-agent' AND value <> ''").join(mine, ["host", "section"], "left_semi")
    return rules.select("host", F.col("value").alias("prefix"), (F.col("field") == "allow").alias("allow")).distinct()


def allowed_by_robots(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """`pages` with `allowed`: the longest rule of its host that an address begins with decides, an allowing one on
    ties; without one it is allowed. Addresses that are not http or https are not."""
    rows = with_host(pages, url).withColumn("_id", F.monotonically_increasing_id())
    rows = cut(rows, "pages")
    hit = rows.select("_id", "host", "path").join(rules, "host").where(F.startswith("path", "prefix"))
    verdict = hit.groupBy("_id").agg(F.max(F.struct(F.length("prefix").alias("n"), "allow"))["allow"].alias("_rule"))
    return rows.join(verdict, "_id", "left").withColumn("allowed", (F.col("host") != "") & F.coalesce("_rule", F.lit(True))).drop("_id", "_rule", "host", "path")


def bundle(spark: SparkSession, path: str, names: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of a bundle by name, and its metadata of one row."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}, spark.read.json(f"{path}/meta")
