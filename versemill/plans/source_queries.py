"""Queries that write tables in a source's own format, read them back and are compared with the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versemill.functions import phonetics as ph
from versemill.functions import tables as T
from versemill.functions import text as tx
from versemill.operators import lines as ln
from versemill.operators import trie as tr
from versemill.operators import web
from versemill.plans import sql as S
from versemill.plans.agent_queries import _SEQ, sequences
from versemill.plans.corpus_queries import MATERIAL
from versemill.plans.lineage import shared_dir
from versemill.plans.poem_queries import DOCS, POEMS, WEB
from versemill.plans.session import table
from versemill.plans.verse_queries import _DOC_LINES, _rendered, _words_of
from versemill.sources import html, readers, writers

QUERIES, SQL = {}, {}
#: CSV with line ends, quotes and blanks kept.
CSV = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def place(spark: SparkSession, name: str) -> str:
    """A new location in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def counted(df: DataFrame, text: str = "text") -> DataFrame:
    return df.groupBy(F.md5(text).alias("digest")).agg(F.count("*").alias("n"))


_GENRES = lambda names: "CASE rec_no % 3 " + " ".join(f"WHEN {k} THEN {S.q(n)}" for k, n in enumerate(names)) + " END"


def _genre(names: list[str]):
    return F.get(F.array(*map(F.lit, names)), (F.col("rec_no") % 3).cast("int"))


@query(f"SELECT md5(text) AS digest, count(*) AS n FROM {POEMS} WHERE text IS NOT NULL AND rec_no % 3 < 2 GROUP BY 1")
def read_poems_parquet(spark, sf_dir):
    """Poems in Parquet with a column of genres; the spelling of the genre may have other cases and blanks."""
    path = place(spark, "poems")
    table(spark, sf_dir, POEMS).select("text", _genre(["luc_bat", " Luc_Bat\n", "luc_bat_khac"]).alias("the_loai")).write.parquet(path)
    return counted(readers.poems_parquet(spark, path))


@query(f"SELECT md5(text) AS digest, count(*) AS n FROM {POEMS} WHERE text <> '' AND rec_no % 3 < 2 GROUP BY 1")
def read_poems_csv(spark, sf_dir):
    """Poems in CSV; a genre that merely contains the name is another one."""
    path = place(spark, "poems")
    table(spark, sf_dir, POEMS).where("text <> ''").select(_genre(["lục bát", "Lục Bát ", "thơ lục bát"]).alias("gender"), F.col("text").alias("content")).write.options(**CSV).csv(path)
    return counted(readers.poems_csv(spark, path))


@query(f"SELECT md5(line) AS digest, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM {POEMS} WHERE text IS NOT NULL) WHERE line <> '' GROUP BY 1")
def read_text_blocks(spark, sf_dir):
    """Text files as blocks; the lines of all blocks are those of the poems."""
    path = place(spark, "texts")
    table(spark, sf_dir, POEMS).where("text IS NOT NULL").select("text").write.text(path)
    return counted(readers.text_block(spark, path).select(F.explode(F.split("text", "\n")).alias("text")).where("text <> ''"))


_STAGING = f"SELECT *, {_GENRES(['luc bat', ' Luc  Bat', 'tu do'])} AS genre, array_to_string(list_filter(list_transform(regexp_split_to_array(nfc_normalize(text), '\\r\\n|\\r|\\n'), lambda x: {S.squeeze('x')}), lambda x: x <> ''), chr(10)) AS staged FROM {POEMS} WHERE text <> ''"


def _staging(spark, sf_dir, limit=None):
    path = place(spark, "staging")
    rows = table(spark, sf_dir, POEMS).where("text <> ''")
    rows = rows.select(F.col("rec_no").alias("id"), "title", "url", _genre(["luc bat", " Luc  Bat", "tu do"]).alias("genre"), F.col("text").alias("content"))
    rows.repartitionByRange(3, "id").sortWithinPartitions("id").write.options(**CSV).csv(path)
    return readers.staging_csv(spark, path, limit=limit)


@query(f"SELECT rec_no AS id, md5(staged) AS digest FROM ({_STAGING}) WHERE rec_no % 3 < 2 AND staged <> ''")
def read_staging_csv(spark, sf_dir):
    """The staged texts of one genre."""
    return _staging(spark, sf_dir)[0].select(F.col("id").cast("long").alias("id"), F.md5("text").alias("digest"))


@query(f"SELECT {S.squeeze('lower(genre)')} AS genre, count(*) AS n FROM ({_STAGING}) GROUP BY 1")
def staging_genres(spark, sf_dir):
    return _staging(spark, sf_dir)[1]


@query(f"SELECT rec_no AS id FROM ({_STAGING}) WHERE rec_no % 3 < 2 AND staged <> '' ORDER BY rec_no LIMIT 25")
def read_staging_first(spark, sf_dir):
    """The first 25 records in file order, whatever the number of files."""
    return _staging(spark, sf_dir, limit=25)[0].select(F.col("id").cast("long").alias("id"))


@query(f"SELECT rec_no, md5(text) AS digest, url FROM {WEB}")
def read_jsonl(spark, sf_dir):
    """JSON lines written in order of a key and read back: the texts as they were."""
    path = place(spark, "lines")
    writers.write_jsonl(table(spark, sf_dir, WEB).select("rec_no", "text", "url"), path, "rec_no")
    return readers.jsonl(spark, path, "rec_no long, text string, url string").select("rec_no", F.md5("text").alias("digest"), "url")


@query(f"SELECT rec_no // 8 AS prompt_id, md5(text) AS digest, count(*) AS n FROM {WEB} WHERE text IS NOT NULL GROUP BY ALL")
def read_candidate_dump(spark, sf_dir):
    """Candidate pools as one JSON document a task, with their candidates in arrays."""
    path = place(spark, "dump")
    rows = table(spark, sf_dir, WEB).where("text IS NOT NULL").groupBy(F.expr("rec_no DIV 8").cast("string").alias("prompt_id"))
    rows.agg(F.collect_list(F.struct(F.col("text").alias("poem"))).alias("candidates")).select("prompt_id", F.lit("p").alias("prompt"), "candidates").write.json(path)
    found = readers.candidate_dump(spark, path, multi_line=False)
    return found.groupBy(F.col("prompt_id").cast("long").alias("prompt_id"), F.md5("poem").alias("digest")).agg(F.count("*").alias("n"))


@query(f"SELECT CASE rec_no % 4 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'REJECT' WHEN 2 THEN '' ELSE 'ACCEPT' END AS decision, count(*) AS n FROM {POEMS} GROUP BY 1")
def read_review_csv(spark, sf_dir):
    """A review form written with blank columns, filled in under two headers and read back."""
    path = place(spark, "review")
    n = F.col("rec_no") % 4
    form = writers.review_form(table(spark, sf_dir, POEMS).select("rec_no", "title"), "rec_no", ["rec_no", "title"], ["notes"])
    first = F.when(n == 0, " accept ").when(n == 1, "Reject").when(n == 3, "accept")
    writers.write_form(form.select("*", first.alias("decision_accept_reject"), F.when(n == 3, "ACCEPT").alias("modecision_accept_reject")), path)
    return readers.review_csv(spark, path).groupBy("decision").agg(F.count("*").alias("n"))


@query(f"SELECT rec_no, printf('DA%0' || greatest(3, length(n::VARCHAR)) || 'd', row_number() OVER (ORDER BY sha256(rec_no::VARCHAR), rec_no)) AS review_id FROM (SELECT rec_no, 3 AS n FROM {POEMS})")
def review_form(spark, sf_dir):
    """The numbers of a review form, in the order of digests."""
    return writers.review_form(table(spark, sf_dir, POEMS).select("rec_no"), "rec_no", ["rec_no"], []).select("rec_no", "review_id")


@query(f"SELECT count(*) AS n, count(DISTINCT title) AS titles FROM (SELECT {S.strip('title')} AS title FROM {DOCS} WHERE {S.strip('title')} <> '' AND NOT starts_with({S.strip('title')}, '#'))")
def read_phrase_list(spark, sf_dir):
    """Titles as a lexicon file with comments and blank lines; its length is checked."""
    path = place(spark, "phrases")
    titles = table(spark, sf_dir, DOCS).select(F.regexp_replace("title", T.LINE_END, " ").alias("title"))
    titles.select(F.explode(F.array(F.concat(F.lit("  "), "title"), F.lit("# note"), F.lit(" "))).alias("value")).where("value IS NOT NULL").coalesce(1).write.text(path)
    found = readers.phrase_list(spark, path, most=10_000_000)
    return spark.createDataFrame([(len(found), len(set(found)))], "n long, titles long")


_CALLED = lambda unseen: S.strip("regexp_replace(nfc_normalize('câu ' || line), " + S.q(f"[{unseen}]") + ", '', 'g')")
_LINES = f"SELECT id, pos, {S.strip('regexp_replace(' + _CALLED('\\x{feff}') + ', ' + S.q('[“”' + chr(34) + ']+$') + ', ' + chr(39) * 2 + ')')} AS line FROM ({_rendered(POEMS, 'rec_no')})"


def _pasted(spark, sf_dir, head: list, foot: list) -> DataFrame:
    """(file, ord, line): the lines of each poem behind `head` and before `foot`, which may hold {n} for the record."""
    rows = ln.rendered_lines(table(spark, sf_dir, POEMS), "rec_no").select(F.col("id").alias("file"), (F.col("pos") + 10).alias("ord"), F.concat(F.lit("câu "), "line").alias("line"))
    edge = lambda lines, start: F.array(*[F.struct(F.lit(start + k).alias("ord"), F.replace(F.lit(x), F.lit("{n}"), F.col("file").cast("string")).alias("line")) for k, x in enumerate(lines)])
    files = rows.select("file").distinct().select("file", F.explode(F.concat(edge(head, 0), edge(foot, 1_000_000))).alias("x")).select("file", "x.ord", "x.line")
    return rows.union(files)


@query(
    f"SELECT id AS file, 'https://a.example/' || id AS url, 'Thơ chúc Tết hay' AS category, CASE WHEN extra THEN 'Bài thơ chúc Tết ngắn' ELSE 'Bài ' || id END AS label, CASE WHEN extra THEN md5('cuối') ELSE md5(string_agg(line, chr(10) ORDER BY pos)) END AS digest FROM ({_LINES}), (VALUES (false), (true)) v(extra) GROUP BY id, extra"
)
def read_labeled_paste(spark, sf_dir):
    """Poems pasted with address, category, number and title: one group under each of the last two."""
    rows = _pasted(spark, sf_dir, ["nobody's line", "Nguồn: https://a.example/{n}", "Thơ chúc Tết hay", "Bài thơ {n}."], ["---", "Bài thơ chúc Tết ngắn", '“cuối”'])
    found = readers.labeled_paste(rows)
    return found.select("file", "url", "category", "label", F.md5(F.array_join("lines", "\n")).alias("digest"))


@query(f"SELECT id AS file, 'https://b.example/' || id AS url, CASE WHEN extra THEN 'Ẩn danh' END AS author, CASE WHEN extra THEN md5('một' || chr(10) || 'hai') ELSE md5(string_agg(line, chr(10) ORDER BY pos)) END AS digest FROM (SELECT id, pos, {_CALLED('\\x{200b}\\x{feff}')} AS line FROM ({_rendered(POEMS, 'rec_no')})), (VALUES (false), (true)) v(extra) GROUP BY id, extra")
def read_manual_paste(spark, sf_dir):
    """Poems pasted with address and author; numbers before lines go, blank lines do not end a group."""
    rows = _pasted(spark, sf_dir, ["Nguồn: https://b.example/{n}"], ["Khám phá thêm", "Tác giả: Ẩn danh", "1. một", "", "2) hai"])
    return readers.manual_paste(rows).select("file", "url", "author", F.md5(F.array_join("lines", "\n")).alias("digest"))


@query(f"SELECT id, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest, coalesce(first(line ORDER BY pos) FILTER (length(line) < 180), '') AS title, 'A & B' AS author FROM ({_DOC_LINES}) GROUP BY id")
def read_html(spark, sf_dir):
    """Documents as pages: a line in each block, with hidden elements, nested ones too, between them."""
    rows = ln.rendered_lines(table(spark, sf_dir, DOCS), "doc_id")
    safe = F.replace(F.replace(F.replace("line", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    k = F.col("pos") % 3
    block = F.when(k == 0, F.concat(F.lit("<p> "), safe, F.lit(" </p><nav>no<div>no</div><script>if (a < b) no</script>no</nav>"))).when(k == 1, F.concat(F.lit("<b>"), safe, F.lit("</b><br>"))).otherwise(F.concat(F.lit("<li>"), safe, F.lit("</footer></li><style>no</style>")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", block.alias("b")))), lambda x: x["b"]), "")
    pages = rows.groupBy("id").agg(F.concat(F.lit("<html><head><meta NAME='Author' content=' A &amp; B '><meta name='x' content='y'></head><body>"), body, F.lit("</body></html>")).alias("html"))
    found = html.page_lines(pages)
    return found.select("id", F.size("page.lines").cast("long").alias("lines"), F.md5(F.array_join("page.lines", "\n")).alias("digest"), "title", "author")


_HOST = "regexp_extract(lower(trim(url)), '^https?://([^/?#:]+)', 1)"
_PATH = "coalesce(nullif(regexp_extract(trim(url), '^[a-zA-Z]+://[^/?#]*(/[^?#]*)', 1), ''), '/')"


@query(f"SELECT doc_id, {_HOST} <> '' AND NOT (length({_HOST}) % 2 = 0 AND starts_with({_PATH}, '/') AND NOT starts_with({_PATH}, '/b')) AS allowed FROM {DOCS} WHERE url IS NOT NULL")
def fetch_gate(spark, sf_dir):
    """Addresses against the robots files of their hosts: hosts of even length forbid all but what begins with /b."""
    pages = table(spark, sf_dir, DOCS).where("url IS NOT NULL").select("doc_id", "url")
    hosts = readers.with_host(pages).select("host").where("host <> ''").distinct()
    text = F.when(F.length("host") % 2 == 0, "# a note\nUser-agent: other\nDisallow:\n\nUser-Agent: *\nDisallow: /\nAllow: /b\n").otherwise("User-agent: other\nDisallow: /\n")
    rules = readers.robots_rules(hosts.select("host", text.alias("robots")))
    return readers.allowed_by_robots(pages, rules).select("doc_id", "allowed")


@query(f"SELECT DISTINCT w AS token, {S.tone('w')} AS tone, {S.rhyme('w')} AS rhyme, {S.syllable('w')} AS valid FROM {_words_of(WEB)}")
def vocabulary_attributes(spark, sf_dir):
    words = table(spark, sf_dir, WEB).select(F.explode(tx.tokens(tx.nfc(F.col("text")))).alias("token")).distinct()
    return readers.vocabulary_attributes(words).select("token", "tone", "rhyme", "valid")


@query(f"SELECT CASE rec_no % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split, count(*) AS n, count(text) AS texts FROM {POEMS} GROUP BY 1")
def write_splits(spark, sf_dir):
    path = place(spark, "splits")
    writers.write_splits(table(spark, sf_dir, POEMS).select("text", _genre(["train", "dev", "test"]).alias("split")), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.count("text").alias("texts"))


@query(f"SELECT 'staging-v1' AS version, count(*) AS records, count(DISTINCT split) AS splits, 1::BIGINT AS inputs FROM {POEMS}")
def write_report(spark, sf_dir):
    """A report of one row on a table and the digest of the file that it was made of, written and read back."""
    path, made = place(spark, "report"), place(spark, "input")
    rows = table(spark, sf_dir, POEMS)
    rows.select("rec_no").coalesce(1).write.parquet(made)
    digests = writers.file_digests(spark, f"{made}/*.parquet").agg(F.count_if(F.col("sha256").rlike("^[0-9a-f]{64}$")).alias("inputs"))
    stats = rows.agg(F.count("*").alias("records"), F.countDistinct("split").alias("splits")).join(F.broadcast(digests)).withColumn("version", F.lit("staging-v1"))
    writers.write_report(stats, path)
    return spark.read.schema("version string, records long, splits long, inputs long").json(path)


@query(f"SELECT count(*) AS n, sum(rec_no)::BIGINT AS total FROM {WEB}")
def append_once(spark, sf_dir):
    """Two batches, one of which comes again after a failure."""
    path = place(spark, "batches")
    rows = table(spark, sf_dir, WEB).select("rec_no")
    for number, part in ((0, "rec_no % 2 = 0"), (1, "rec_no % 2 = 1"), (1, "rec_no % 2 = 1")):
        writers.append_once(rows.where(part), number, path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.sum("rec_no").alias("total"))


@query(f"SELECT root, count(*) AS nodes, count(*) FILTER (complete) AS complete, 'assets-v1' AS version FROM (SELECT root, path, bool_or(d = len(tk)) AS complete FROM (SELECT root, tk, d, array_to_string(tk[:d], chr(1)) AS path FROM (SELECT *, unnest(range(1, len(tk) + 1)) AS d FROM ({_SEQ}))) GROUP BY ALL) GROUP BY root")
def asset_bundle(spark, sf_dir):
    """The decoding tables written as one bundle with their metadata and read back."""
    path = place(spark, "assets")
    rows = sequences(spark, sf_dir)
    writers.write_bundle({"nodes": tr.nodes(rows), "masks": tr.token_masks(rows)}, {"version": "assets-v1"}, path)
    tables, meta = readers.bundle(spark, path, ["nodes", "masks"])
    return tables["nodes"].groupBy("root").agg(F.count("*").alias("nodes"), F.count_if("complete").alias("complete")).join(F.broadcast(meta.select("version")))


@query(f"SELECT rec_no, rec_no % 2 = 0 AS same, coalesce(title, '') AS title FROM {POEMS}")
def paired_selections(spark, sf_dir):
    """Two selections joined one to one by their key; the columns that must agree do."""
    rows = table(spark, sf_dir, POEMS).select("rec_no", F.coalesce("title", F.lit("")).alias("title"))
    both = web.paired_selections(rows.withColumn("score", F.col("rec_no")), rows.withColumn("score", F.col("rec_no") + F.col("rec_no") % 2), "rec_no", ["title"])
    return both.select("rec_no", (F.col("score") == F.col("score_b")).alias("same"), "title")


@query(f"SELECT DISTINCT a.duplicate_cluster FROM {POEMS} a JOIN {POEMS} b USING (duplicate_cluster) WHERE a.split = 'train' AND b.split = 'dev'")
def in_both(spark, sf_dir):
    """Clusters that the train and the dev split share and should not."""
    rows = table(spark, sf_dir, POEMS).where("duplicate_cluster IS NOT NULL")
    return web.in_both(rows.where("split = 'train'"), rows.where("split = 'dev'"), ["duplicate_cluster"])


@query(f"SELECT rec_no, (41 - rec_no)::INT AS ord FROM {POEMS} WHERE rec_no BETWEEN 2 AND 41")
def chosen(spark, sf_dir):
    """A wanted list of records, in its own order; a missing one would fail."""
    return web.chosen(table(spark, sf_dir, POEMS).select("rec_no"), list(range(41, 1, -1)), "rec_no").select("rec_no", "ord")
