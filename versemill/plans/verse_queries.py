"""Queries on sounds, lines, rhymes and windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versemill.functions import phonetics as ph
from versemill.functions import tables as T
from versemill.functions import text as tx
from versemill.operators import lines as ln
from versemill.plans import sql as S
from versemill.plans.session import table

QUERIES, SQL = {}, {}
POEMS, WEB, DOCS = "quality_fsoft_v1", "tet4_web_staging_v1", "documents"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def token_column(df: DataFrame) -> DataFrame:
    return df.select(F.explode(tx.tokens(tx.nfc(F.col("text")))).alias("w"))


def _words_of(name: str) -> str:
    return f"(SELECT unnest({S.tokens('nfc_normalize(text)')}) AS w FROM {name} WHERE text IS NOT NULL)"




@query(f"SELECT {S.rhyme('w')} AS rhyme, count(*) AS n, count(DISTINCT w) AS words FROM (SELECT tk[-1] AS w FROM ({S.line_table(DOCS, 'doc_id')})) GROUP BY 1 HAVING rhyme <> ''")
def rhyme_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rhymes of the line ends of all documents: lines and distinct words."""
    ends = ln.line_table(table(spark, sf_dir, DOCS), "doc_id").select(F.element_at("tk", -1).alias("w")).groupBy("w").count()
    return ends.select(ph.rhyme(F.col("w")).alias("rhyme"), "count").where("rhyme <> ''").groupBy("rhyme").agg(F.sum("count").alias("n"), F.count("*").alias("words"))


@query(f"SELECT {S.tone('w')} AS tone, {S.bang('w')} AS bang, {S.trac('w')} AS trac, count(*) AS n FROM {_words_of(WEB)} GROUP BY ALL")
def tone_histogram(spark, sf_dir):
    """Tones of all words; validity and tone are asked of distinct words."""
    each = token_column(table(spark, sf_dir, WEB)).groupBy("w").count()
    w = F.col("w")
    return each.select(ph.tone(w).alias("tone"), ph.is_bang(w).alias("bang"), ph.is_trac(w).alias("trac"), "count").groupBy("tone", "bang", "trac").agg(F.sum("count").alias("n"))


@query(f"SELECT DISTINCT w AS word, {S.marks('w')} AS marks, {S.syllable('w')} AS valid, {S.lexicon('w')} AS lexicon_valid FROM {_words_of(DOCS)}")
def syllable_validity(spark, sf_dir):
    w = F.col("w")
    each = token_column(table(spark, sf_dir, DOCS)).distinct()
    return each.select(w.alias("word"), ph.tone_marks(w).alias("marks"), ph.is_syllable(w).alias("valid"), ph.is_lexicon_syllable(w).alias("lexicon_valid"))


@query(
    f"SELECT DISTINCT w AS word, {S.tone('w')} AS tone, {S.detoned('w')} AS bare, {S.rhyme('w')} AS rhyme, CASE {S.tone('w')} WHEN 'ngang' THEN 0 WHEN 'huyền' THEN 1 WHEN 'unknown' THEN NULL ELSE 2 END AS tone_bit FROM {_words_of(POEMS)}"
)
def syllable_dimension(spark, sf_dir):
    """What is known of each distinct word: vocabulary-sized work instead of corpus-sized."""
    w = F.col("w")
    each = token_column(table(spark, sf_dir, POEMS)).distinct()
    return each.select(w.alias("word"), ph.tone(w).alias("tone"), ph.detoned(w).alias("bare"), ph.rhyme(w).alias("rhyme"), ph.tone_bit(w).alias("tone_bit"))


_COUPLETS = f"""
SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) AS nth, tk[6] AS l6, bat[6] AS b6, bat[8] AS b8 FROM (
  SELECT *, lead(tk) OVER (PARTITION BY id ORDER BY pos) AS bat FROM ({S.line_table("(SELECT rec_no, regexp_replace(" + S.strip("nfc_normalize(text)") + ", " + S.q(f"(?i)^thơ{T.WS}+lục{T.WS}+bát{T.WS}*:?{T.WS}*") + ", '') AS text FROM " + POEMS + ")", "rec_no", punctuation=T.PUNCT_CORPUS)}) WHERE len(tk) IN (6, 8)
) WHERE len(tk) = 6 AND len(bat) = 8"""
_LINKED = f"SELECT *, lead(l6) OVER (PARTITION BY id ORDER BY nth) AS next6 FROM ({_COUPLETS})"
_PAIRS = f"SELECT id, least(a, b) AS w1, greatest(a, b) AS w2 FROM (SELECT id, l6 AS a, b6 AS b FROM ({_LINKED}) UNION ALL SELECT id, b8, next6 FROM ({_LINKED}) WHERE next6 IS NOT NULL) WHERE {S.bang('a')} AND {S.bang('b')}"
_COUNTS = f"SELECT w1, w2, count(*) AS frequency FROM ({_PAIRS}) GROUP BY ALL"
_DICT = f"SELECT rhyme, list_sort(list(DISTINCT w)) AS words FROM (SELECT {S.rhyme('w')} AS rhyme, w FROM (SELECT w1 AS w FROM ({_PAIRS}) UNION SELECT w2 FROM ({_PAIRS}))) WHERE rhyme <> '' GROUP BY rhyme"


def poem_couplets(spark, sf_dir, keep=[]):
    return ln.couplets(table(spark, sf_dir, POEMS), "rec_no", keep=keep)


@query(f"SELECT id, nth, l6, b6, b8, next6, {S.kind(S.rhyme('l6'), S.rhyme('b6'))} AS inner_kind, {S.kind(S.rhyme('b8'), S.rhyme('next6'))} AS link_kind FROM ({_LINKED})")
def couplet_table(spark, sf_dir):
    """Couplets with the kinds of their inner rhyme and of the link to the next one."""
    rows = poem_couplets(spark, sf_dir)
    c = F.col
    return rows.select("id", "nth", "l6", "b6", "b8", "next6", ph.rhyme_kind(c("l6"), c("b6")).alias("inner_kind"), ph.rhyme_kind(c("b8"), c("next6")).alias("link_kind"))


@query(_COUNTS)
def couplet_rhyme_pairs(spark, sf_dir):
    return ln.pair_counts(ln.rhyme_pairs(poem_couplets(spark, sf_dir)))


@query(f"SELECT rhyme, array_to_string(words, ' ') AS words, len(words) AS n FROM ({_DICT})")
def rhyme_dictionary(spark, sf_dir):
    return ln.rhyme_dictionary(ln.rhyme_pairs(poem_couplets(spark, sf_dir))).select("rhyme", F.array_join("words", " ").alias("words"), F.size("words").alias("n"))


@query(f"SELECT w1, w2, CAST(sum(frequency) AS BIGINT) AS frequency FROM (SELECT w1, w2, id % 3 AS part, count(*) AS frequency FROM ({_PAIRS}) GROUP BY ALL) GROUP BY ALL")
def merge_rhyme_dicts(spark, sf_dir):
    """Three dictionaries, made of a third of the poems each, merged again."""
    parts = ln.rhyme_pairs(poem_couplets(spark, sf_dir), ["id"]).withColumn("part", F.col("id") % 3)
    counted = parts.groupBy("part", "w1", "w2").agg(F.count("*").alias("frequency"))
    groups = ln.rhyme_dictionary(parts)
    return ln.merge_dictionaries(counted, groups)[0]


_CLEAN = f"SELECT * FROM ({_COUNTS}) WHERE frequency >= 2 AND {S.syllable('w1')} AND {S.syllable('w2')}"


@query(_CLEAN)
def filter_noise(spark, sf_dir):
    return ln.clean_pairs(couplet_rhyme_pairs(spark, sf_dir))


@query(f"SELECT rhyme, string_agg(w, ' ' ORDER BY w) AS words FROM (SELECT rhyme, unnest(words) AS w FROM ({_DICT})) WHERE w IN (SELECT w1 FROM ({_CLEAN}) UNION SELECT w2 FROM ({_CLEAN})) GROUP BY rhyme")
def surviving_groups(spark, sf_dir):
    pairs = ln.rhyme_pairs(poem_couplets(spark, sf_dir))
    kept = ln.surviving_groups(ln.rhyme_dictionary(pairs), ln.clean_pairs(ln.pair_counts(pairs)))
    return kept.select("rhyme", F.array_join("words", " ").alias("words"))


@query(
    f"SELECT DISTINCT w AS syllable FROM (SELECT w FROM (SELECT unnest({S.tokens('nfc_normalize(text)', T.PUNCT_CORPUS)}) AS w FROM {WEB} WHERE text IS NOT NULL) GROUP BY w HAVING count(*) >= 2 AND {S.lexicon('w')} UNION ALL SELECT w FROM (SELECT unnest(words) AS w FROM ({_DICT})) WHERE {S.lexicon('w')}) WHERE w NOT IN ({', '.join(S.q(b) for b in T.FOREIGN)})"
)
def syllable_vocab(spark, sf_dir):
    named = ln.rhyme_dictionary(ln.rhyme_pairs(poem_couplets(spark, sf_dir)))
    return ln.syllable_vocabulary(table(spark, sf_dir, WEB), "text", named, T.FOREIGN)


def _rendered(t, key):
    split = f"SELECT {key} AS id, unnest(string_split(nfc_normalize(text), chr(10))) AS line, generate_subscripts(string_split(nfc_normalize(text), chr(10)), 1) AS ord0 FROM {t} WHERE text IS NOT NULL"
    return f"SELECT id, row_number() OVER (PARTITION BY id ORDER BY ord0) - 1 AS pos, line FROM (SELECT id, ord0, {S.squeeze('line')} AS line FROM ({split})) WHERE line <> ''"


_DOC_LINES = _rendered(DOCS, "doc_id")
_EDGED = S.q(f"(^|{T.EDGE})(" + "|".join(T.SEASON) + f")({T.EDGE}|$)")
_PAGES = f"SELECT id, bool_or(regexp_matches(lower(line), {_EDGED})) AS page_is_tet FROM ({_DOC_LINES}) WHERE pos < 20 GROUP BY id"
_WINDOWS = f"SELECT * FROM (SELECT id, pos, array_to_string(list(line) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), chr(10)) AS win, count(*) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n FROM ({_DOC_LINES})) WHERE n = 4"
_GATED = f"SELECT w.id, w.pos, w.win, p.page_is_tet FROM ({_WINDOWS}) w JOIN ({_PAGES}) p USING (id) WHERE p.page_is_tet OR regexp_matches(lower(win), {_EDGED})"


def gated_windows(spark, sf_dir):
    rows = ln.rendered_lines(table(spark, sf_dir, DOCS), "doc_id")
    return ln.windows(rows).join(ln.season_pages(rows), "id").where(F.col("page_is_tet") | ln.season(F.col("window")))


@query(f"SELECT id, pos, page_is_tet, md5(win) AS digest FROM ({_GATED})")
def sliding_windows(spark, sf_dir):
    """Four neighbouring lines, of season pages or speaking of the season themselves."""
    return gated_windows(spark, sf_dir).select("id", "pos", "page_is_tet", F.md5("window").alias("digest"))


@query(
    f"SELECT id, x AS pos FROM (SELECT id, unnest(list_reduce(list_transform(list_sort(list(pos)), lambda o: [o]), lambda a, b: CASE WHEN b[1] >= a[-1] + 4 THEN list_concat(a, b) ELSE a END)) AS x FROM ({_GATED}) GROUP BY id)"
)
def window_select(spark, sf_dir):
    """Windows of a page kept from the first on, none overlapping another."""
    kept = gated_windows(spark, sf_dir).groupBy("id").agg(ln.greedy(F.collect_list("pos")).alias("kept"))
    return kept.select("id", F.explode(F.col("kept").cast("array<bigint>")).alias("pos"))


@query(
    f"""SELECT id, k AS block, CASE WHEN n = 4 THEN 'native_four_line' WHEN k = 1 THEN 'derived_leading' WHEN k = n // 4 AND n % 4 = 0 THEN 'derived_trailing' ELSE 'derived_interior' END AS kind,
md5(array_to_string(a[(k - 1) * 4 + 1 : k * 4], chr(10))) AS digest, coalesce(length(array_to_string(a[1 : (k - 1) * 4], chr(10))), 0) AS before_chars, coalesce(length(array_to_string(a[k * 4 + 1 :], chr(10))), 0) AS after_chars, n % 4 AS remainder
FROM (SELECT id, a, n, unnest(range(1, n // 4 + 1)) AS k FROM (SELECT id, list(line ORDER BY pos) AS a, count(*) AS n FROM ({_rendered(POEMS, "rec_no")}) GROUP BY id) WHERE n >= 4)"""
)
def tumbling_blocks(spark, sf_dir):
    rows = ln.blocks(ln.rendered_lines(table(spark, sf_dir, POEMS), "rec_no"))
    return rows.select("id", F.col("block").cast("long").alias("block"), "kind", F.md5("block_text").alias("digest"), F.length("before").cast("long").alias("before_chars"), F.length("after").cast("long").alias("after_chars"), F.col("remainder").cast("long").alias("remainder"))


@query(f"SELECT id, k AS block, (k - 1) * 4 AS first_line, md5(coalesce(array_to_string(a[greatest(1, (k - 1) * 4 - 1) : (k - 1) * 4], chr(10)), '')) AS before, md5(coalesce(array_to_string(a[k * 4 + 1 : k * 4 + 2], chr(10)), '')) AS after FROM (SELECT id, a, n, unnest(range(1, n // 4 + 1)) AS k FROM (SELECT id, list(line ORDER BY pos) AS a, count(*) AS n FROM ({_DOC_LINES}) GROUP BY id) WHERE n >= 4)")
def block_context(spark, sf_dir):
    """Blocks of the documents, long ones too, with two lines before and after."""
    rows = ln.blocks(ln.rendered_lines(table(spark, sf_dir, DOCS), "doc_id"), context=2)
    return rows.select("id", F.col("block").cast("long").alias("block"), F.col("first_line").cast("long").alias("first_line"), F.md5("before").alias("before"), F.md5("after").alias("after"))


@query(
    f"SELECT rec_no, CAST(CASE WHEN len(a) = 0 THEN '' ELSE array_to_string(a, chr(10)) END AS VARCHAR) AS staged FROM (SELECT rec_no, list_filter(list_transform(regexp_split_to_array(nfc_normalize(coalesce(text, '')), '\\r\\n|\\r|\\n'), lambda x: {S.squeeze('x')}), lambda x: x <> '') AS a FROM {WEB})"
)
def staged_text(spark, sf_dir):
    return table(spark, sf_dir, WEB).select("rec_no", tx.staged(F.col("text")).alias("staged"))
