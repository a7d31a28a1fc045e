"""Queries on requests, retrieval, prompts, audits and decoding assets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.functions import registry
from versemill.functions import tables as T
from versemill.functions import text as tx
from versemill.operators import agent as ag
from versemill.operators import audit as au
from versemill.operators import lines as ln
from versemill.operators import prompts as pr
from versemill.operators import trie as tr
from versemill.operators import web
from versemill.operators import decode
from versemill.plans import sql as S
from versemill.plans.corpus_queries import MATERIAL
from versemill.plans.lineage import cut
from versemill.plans.poem_queries import DOCS, POEMS, WEB, eval_sql
from versemill.plans.session import table
from versemill.plans.verse_queries import _DICT, _DOC_LINES, _GATED, _words_of, gated_windows, poem_couplets, token_column

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LOW = ag._LOW
_EDGED = lambda words: S.q(f"(^|{T.EDGE})(" + "|".join(words) + f")({T.EDGE}|$)")


@query(
    f"""SELECT doc_id, topic, CASE WHEN num = '' THEN 4 ELSE num::BIGINT END AS num_lines, array_to_string(keys[:5], ' ') AS keywords, CASE WHEN rhyme <> '' THEN rhyme END AS rhyme FROM (SELECT doc_id, {S.strip('t')} AS topic, regexp_extract(lower(t), {S.q(f'([0-9]+){T.WS}*(?:câu|dòng)')}, 1) AS num, regexp_extract(lower(t), {S.q(f'vần{T.WS}+([{_LOW}]{{1,4}})({T.EDGE}|$)')}, 1) AS rhyme,
list_filter(regexp_split_to_array(lower(t), {S.q(f'[^{_LOW}]+')}), lambda w: w <> '' AND NOT list_contains({S.array(ag.REQUEST_STOP)}, w)) AS keys FROM (SELECT doc_id, 'Viết bài thơ ' || (doc_id % 5 + 1) * 2 || ' câu vần ' || ['an', 'ương', 'xuân', 'a'][doc_id % 4 + 1] || ' về ' || coalesce(title, '') AS t FROM {DOCS}))"""
)
def parse_request(spark, sf_dir):
    """Free requests made of titles, parsed into metadata."""
    rhymes = F.array(*map(F.lit, ["an", "ương", "xuân", "a"]))
    t = F.concat(F.lit("Viết bài thơ "), ((F.col("doc_id") % 5 + 1) * 2).cast("string"), F.lit(" câu vần "), F.get(rhymes, (F.col("doc_id") % 4).cast("int")), F.lit(" về "), F.coalesce("title", F.lit("")))
    m = ag.parse_request(F.col("t"))
    rows = tx.settle(table(spark, sf_dir, DOCS).select("doc_id", t.alias("t")), m=m)
    return rows.select("doc_id", "m.topic", "m.num_lines", F.array_join("m.keywords", " ").alias("keywords"), "m.rhyme")


@query(
    f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({S.strip(chr(114) + 'egexp_replace(' + S.strip('t') + ', ' + S.q('(?i)^viết bài thơ lục bát') + ', ' + chr(39) * 2 + ')')}, {S.q(f'(?i)^[0-9]+{T.WS}*(?:câu|dòng){T.WS}*')}, ''), {S.q(f'(?i)^(?:về|tả|nhớ){T.WS}+')}, ''), '\\.+$', '') AS topic FROM (SELECT doc_id, 'VIẾT bài thơ lục bát ' || (doc_id % 9) || ' Câu về ' || coalesce(title, 'x') || '..' AS t FROM {DOCS})"
)
def request_topic(spark, sf_dir):
    t = F.concat(F.lit("VIẾT bài thơ lục bát "), (F.col("doc_id") % 9).cast("string"), F.lit(" Câu về "), F.coalesce("title", F.lit("x")), F.lit(".."))
    return table(spark, sf_dir, DOCS).select("doc_id", ag.request_topic(t).alias("topic"))


_TITLE = S.strip("title")
_UNSTRAY = lambda x: f"regexp_replace({x}, {S.q('(?i)^(' + ag.STRAY + ')' + T.WS + '*')}, '')"
_RAISED = lambda x: f"upper(substr({x}, 1, 1)) || substr({x}, 2)"


@query(f"SELECT rec_no, {_RAISED('a')} AS answer, {_RAISED('b')} AS bare FROM (SELECT rec_no, {_UNSTRAY(S.strip(S.q('nghẹn ') + ' || ' + _TITLE))} AS a, {_UNSTRAY(_TITLE)} AS b FROM {POEMS})")
def clean_output(spark, sf_dir):
    """Every title, whatever it begins with, as an answer behind a thought and a stray syllable, and behind
    the thought alone; null titles give null."""
    thought, title = F.lit("nghĩ\n</think> "), F.col("title")
    rows = table(spark, sf_dir, POEMS)
    return rows.select("rec_no", ag.clean_output(F.concat(thought, F.lit("nghẹn "), tx.strip(title))).alias("answer"), ag.clean_output(F.concat(thought, title)).alias("bare"))


_RAW = S.q(r"(?is)<think>.*?</think>")
_HEAD = S.q("^(" + "|".join(ag.HEADERS) + ")")


@query(
    f"SELECT doc_id, md5(coalesce(array_to_string(a[:8], chr(10)), '')) AS digest, least(len(a), 8) AS lines FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace('<think>' || coalesce(title, '') || '</think>Chủ đề: x' || chr(10) || text, {_RAW}, '', 'g'), '</?answer>|<\\|im_(?:start|end)\\|>', '', 'g'), {S.q(T.LINE_END)}), lambda x: {S.strip('x')}), lambda x: x <> '' AND NOT regexp_matches(lower(x), {_HEAD})) AS a FROM {DOCS} WHERE text IS NOT NULL)"
)
def extract_poem(spark, sf_dir):
    """Documents as raw model output: thoughts, tags and heads go, eight lines stay."""
    raw = F.concat(F.lit("<think>"), F.coalesce("title", F.lit("")), F.lit("</think>Chủ đề: x\n"), F.col("text"))
    rows = table(spark, sf_dir, DOCS).where("text IS NOT NULL").select("doc_id", ag.extract_poem(raw).alias("p"))
    return rows.select("doc_id", F.md5("p").alias("digest"), F.when(F.col("p") == "", 0).otherwise(F.size(F.split("p", "\n"))).cast("long").alias("lines"))


_KW = f"SELECT id, word, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, first) AS place FROM (SELECT id, word, count(*) AS n, min(i) AS first FROM (SELECT id, i, w[i] AS word FROM (SELECT rec_no AS id, regexp_extract_all(lower(text), {S.q(T.WORD_ANY)}) AS w, unnest(range(1, len(regexp_extract_all(lower(text), {S.q(T.WORD_ANY)})) + 1)) AS i FROM {POEMS} WHERE text IS NOT NULL)) WHERE length(word) >= 2 AND word NOT IN ({', '.join(S.q(w) for w in T.STOP_WORDS)}) GROUP BY ALL) QUALIFY place <= 3"


@query(_KW)
def top_keywords(spark, sf_dir):
    return ag.top_keywords(table(spark, sf_dir, POEMS), "rec_no").select("id", "word", "n", F.col("place").cast("long").alias("place"))


@query(
    f"SELECT rec_no AS id, md5('BÀI THƠ LỤC BÁT' || chr(10) || 'Chủ đề: ' || CASE WHEN t = '' OR lower(t) IN ('null', 'none', 'bài thơ') THEN 'thơ lục bát' ELSE substr(t, 1, 160) END || chr(10) || 'Số câu: ' || n || chr(10) || 'Từ khoá: ' || coalesce(k, '')) AS user_digest, n AS num_lines FROM (SELECT rec_no, {S.squeeze(chr(99) + 'oalesce(title, ' + chr(39) * 2 + ')')} AS t, len(regexp_split_to_array(text, {S.q(T.LINE_END)})) AS n, k FROM {POEMS} LEFT JOIN (SELECT id, string_agg(word, ', ' ORDER BY place) AS k FROM ({_KW}) GROUP BY id) ON id = rec_no WHERE text IS NOT NULL)"
)
def chat_messages(spark, sf_dir):
    rows = ag.chat_messages(table(spark, sf_dir, POEMS).where("text IS NOT NULL"), "rec_no", "text", "title")
    return rows.select("id", F.md5(F.element_at("messages", 2)["content"]).alias("user_digest"), F.col("num_lines").cast("long").alias("num_lines"))


_SIG = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), {_EDGED(w)}) THEN '{n}' END" for n, w in ag.SIGNALS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT signal, count(*) AS n, count(*) FILTER (keep) AS kept FROM (SELECT unnest(s) AS signal, list_contains(s, 'tet_direct') OR (list_contains(s, 'spring_explicit') AND list_contains(s, 'reunion')) AS keep FROM (SELECT {_SIG} AS s FROM {DOCS} WHERE text IS NOT NULL)) GROUP BY signal")
def domain_signals(spark, sf_dir):
    rows = table(spark, sf_dir, DOCS).where("text IS NOT NULL").select(ag.signals(F.col("text")).alias("s"))
    rows = rows.select(F.explode("s").alias("signal"), ag.in_domain(F.col("s")).alias("keep"))
    return rows.groupBy("signal").agg(F.count("*").alias("n"), F.sum(F.col("keep").cast("long")).alias("kept"))


WISHES = [(1, "Chúc ông bà mạnh khỏe"), (2, "bánh tét sum vầy đầu năm"), (3, "mùa xuân quê nhà")]
_FOLD = lambda x: f"translate(regexp_replace(translate(nfc_normalize(lower({x})), {S.q(T.UNACCENT[0])}, {S.q(T.UNACCENT[1])}), '[\\x{{300}}-\\x{{36f}}]', '', 'g'), 'đ', 'd')"
_TERMS = lambda x: f"list_distinct(list_filter(list_transform(regexp_extract_all(nfc_normalize({x}), {S.q(T.WORD_ANY)}), lambda w: {_FOLD('w')}), lambda w: length(w) > 1))"


@query(
    f"SELECT wish_id, rec_no AS material_id, score, place FROM (SELECT wish_id, rec_no, CAST(len(list_intersect(ts, ws)) + b AS BIGINT) AS score, row_number() OVER (PARTITION BY wish_id ORDER BY len(list_intersect(ts, ws)) + b DESC, rec_no) AS place FROM (SELECT rec_no, {_TERMS(chr(99) + 'oncat_ws(' + chr(39) + ' ' + chr(39) + ', text, author, url)')} AS ts, (coalesce(author, '') <> '')::INT AS b FROM {MATERIAL}), (SELECT wish_id, {_TERMS('wish')} AS ws FROM (VALUES "
    + ", ".join(f"({i}, {S.q(w)})" for i, w in WISHES)
    + ") v(wish_id, wish))) WHERE place <= 3"
)
def topk_retrieval(spark, sf_dir):
    wishes = spark.createDataFrame(WISHES, "wish_id int, wish string")
    rows = table(spark, sf_dir, MATERIAL).select(F.col("rec_no").alias("material_id"), "text", "author", "url")
    found = ag.retrieve(wishes, rows)
    return found.select("wish_id", "material_id", F.col("score").cast("long").alias("score"), F.col("place").cast("long").alias("place"))


@query(
    f"SELECT wish_id, rec_no AS material_id, score, place FROM (SELECT wish_id, rec_no, CAST(len(list_intersect(ts, ws)) + b AS BIGINT) AS score, row_number() OVER (PARTITION BY wish_id ORDER BY len(list_intersect(ts, ws)) + b DESC, rec_no) AS place FROM (SELECT rec_no, {_TERMS(chr(99) + 'oncat_ws(' + chr(39) + ' ' + chr(39) + ', text, author, url)')} AS ts, (coalesce(author, '') <> '')::INT AS b FROM {MATERIAL}), (SELECT rec_no AS wish_id, {_TERMS('text')} AS ws FROM {MATERIAL} WHERE rec_no % 50 = 0)) WHERE place <= 3"
)
def topk_retrieval_all(spark, sf_dir):
    """The texts of every fiftieth material as wishes, against all materials."""
    rows = table(spark, sf_dir, MATERIAL).select(F.col("rec_no").alias("material_id"), "text", "author", "url")
    wishes = rows.where("material_id % 50 = 0").select(F.col("material_id").alias("wish_id"), F.col("text").alias("wish"))
    return ag.retrieve_many(wishes, rows).select("wish_id", "material_id", "score", F.col("place").cast("long").alias("place"))


_G = ", ".join(f"len(list_intersect(t, {S.array(g)}))" for g, _ in ag.GUIDES)


@query(f"SELECT doc_id, CASE WHEN greatest({_G}) = 0 THEN {S.q(ag.DEFAULT_GUIDE[0] + '/' + ag.DEFAULT_GUIDE[1])} " + " ".join(f"WHEN len(list_intersect(t, {S.array(g)})) = greatest({_G}) THEN {S.q(k[0] + '/' + k[1])}" for g, k in ag.GUIDES) + f" END AS guide FROM (SELECT doc_id, {_TERMS('title')} AS t FROM {DOCS} WHERE title IS NOT NULL)")
def topic_guide(spark, sf_dir):
    rows = table(spark, sf_dir, DOCS).where("title IS NOT NULL").select("doc_id", ag.guide(F.col("title")).alias("g"))
    return rows.select("doc_id", F.concat(F.get("g", F.lit(0)), F.lit("/"), F.get("g", F.lit(1))).alias("guide"))


_BAD = S.q('["' + chr(92) * 2 + "\x00-\x1f]")
_SAID = "CASE WHEN rec_no % 3 = 0 THEN 'accept' ELSE 'reject' END"


@query(
    f"SELECT rec_no, CASE WHEN text IS NULL OR (bad AND {_SAID} = 'accept') THEN NULL ELSE {_SAID} END AS decision, CASE WHEN text IS NULL OR (bad AND {_SAID} = 'accept') THEN NULL WHEN bad THEN md5(regexp_replace(regexp_replace('\"' || text || '\"', '[ \\t-\\r]+', ' ', 'g'), '^[ ,\"]+|[ ,\"]+$', '', 'g')) ELSE md5(text) END AS issue FROM (SELECT rec_no, text, regexp_matches(text, {_BAD}) AS bad FROM {WEB})"
)
def critic_json(spark, sf_dir):
    """Verdicts whose issue is the text of each row as it stands: line ends and quotes break them, and then they can
    come out as a rejection only."""
    said = F.when(F.col("rec_no") % 3 == 0, "accept").otherwise("reject")
    raw = F.concat(F.lit('Đây: {"decision": "'), said, F.lit('", "issues": ["'), F.col("text"), F.lit('"], "repair_instruction": "sửa"}'))
    rows = tx.settle(table(spark, sf_dir, WEB).select("rec_no", "text"), c=ag.parse_critic(raw))
    return rows.select("rec_no", F.col("c.decision").alias("decision"), F.md5(F.get("c.issues", F.lit(0))).alias("issue"))


@query(f"SELECT rec_no, coalesce(len(a) = 4, false) AS sound, CASE WHEN len(a) = 4 THEN md5(array_to_string(a, '|')) END AS ideas FROM (SELECT rec_no, string_split(text, chr(10)) AS a FROM {POEMS})")
def plan_json(spark, sf_dir):
    """Plans with a line for each line of the text, in a model's chatter; only those of four lines are sound."""
    line = F.transform(F.split("text", "\n"), lambda x, k: F.struct((k + 1).alias("line"), F.lit("r").alias("role"), x.alias("idea"), F.lit("m").alias("image")))
    plan = F.struct(F.lit("r").alias("recipient"), F.lit("w").alias("wish_intent"), F.array(F.lit("a")).alias("keywords"), F.array().cast("array<string>").alias("imagery"), F.lit("t").alias("tone"), line.alias("line_plan"))
    raw = F.concat(F.lit("x "), F.to_json(plan), F.lit(" y"))
    rows = tx.settle(table(spark, sf_dir, POEMS).select("rec_no", "text"), p=F.when(F.col("text").isNotNull(), ag.parse_plan(raw)))
    return rows.select("rec_no", F.col("p").isNotNull().alias("sound"), F.md5(F.array_join(F.col("p.line_plan")["idea"], "|")).alias("ideas"))


_RATED = "SELECT r, i, s, d, coalesce(r BETWEEN 1 AND 5 AND i BETWEEN 1 AND 5 AND s IN (0, 1), false) AS ok FROM (SELECT round(metrics.tcr) % 7 AS r, rec_no % 6 AS i, rec_no % 3 AS s, rec_no % 7 < 6 AS d FROM {WEB})"
_SUMMARY = "SELECT {n} AS n, count(*) FILTER (ok) AS rated, {n} - count(*) FILTER (ok) AS invalid, count(*) FILTER (ok AND d) AS accepted, count(*) FILTER (ok AND NOT d) AS rejected, round_even(coalesce(count(*) FILTER (ok AND d)::DOUBLE / nullif(count(*) FILTER (ok), 0), 0), 4) AS accept_rate, round_even(avg(r) FILTER (ok), 3) AS naturalness, round_even(avg(i) FILTER (ok), 3) AS imagery, count(*) FILTER (ok AND s = 1) AS sensitive, {n} = count(*) FILTER (ok) AND coalesce(count(*) FILTER (ok AND d)::DOUBLE / nullif(count(*) FILTER (ok), 0), 0) >= 0.8 AS gate_passed FROM (" + _RATED.replace("{WEB}", WEB) + ") WHERE {where}"


def _ratings(spark, sf_dir):
    n = F.col("rec_no")
    return table(spark, sf_dir, WEB).select((F.round("metrics.tcr").cast("long") % 7).alias("r"), (n % 6).alias("i"), (n % 3).alias("s"), F.when(n % 7 < 6, " Accept").otherwise("reject").alias("d"))


@query(_SUMMARY.format(n="count(*)", where="ok"))
def audit_ratings(spark, sf_dir):
    """Four ratings made of every row whose ratings are all within their domains; any other would fail the job."""
    rows = _ratings(spark, sf_dir).where("r BETWEEN 1 AND 5 AND i BETWEEN 1 AND 5 AND s IN (0, 1)")
    return au.audit_summary(rows, "r", "i", "s", "d")


@query(_SUMMARY.format(n="count(*)", where="true"))
def audit_summary(spark, sf_dir):
    """Four ratings made of every row, some outside their domain or missing, which are counted apart."""
    return au.audit_summary(_ratings(spark, sf_dir), "r", "i", "s", "d", strict=False)


@query(f"SELECT count(*) AS n, round_even(avg((h = m)::INT::DOUBLE), 4) AS agreement FROM (SELECT CASE rec_no % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'TIE' END AS h, CASE WHEN metrics.tcr > metrics.rma THEN 'A' ELSE 'B' END AS m FROM {WEB}) WHERE h <> 'TIE'")
def agreement(spark, sf_dir):
    """How often a choice made of the row number is the side with the higher of two scores."""
    n = F.col("rec_no") % 3
    human = F.when(n == 0, "A").when(n == 1, "B").otherwise("TIE")
    return au.agreement(table(spark, sf_dir, WEB), human, F.col("metrics.tcr"), F.col("metrics.rma"))


_TOLD = lambda name, **v: S.fill(pr.TEXTS[name], **v)
_COVER = f"printf({S.q(ag.COVERAGE['whole'])}, array_to_string(list_filter([CASE WHEN len(people) > 0 THEN printf({S.q(ag.COVERAGE['named'])}, array_to_string(people, ', ')) END, printf({S.q(ag.COVERAGE['exact'])}, array_to_string(keys, ', ')), printf({S.q(ag.COVERAGE['loose'])}, least(2, len(keys)), len(keys))], lambda x: x IS NOT NULL), '; '))"
_PROMPT = (
    f"array_to_string(list_filter([{S.q(pr.TEXTS['head'])}, CASE WHEN recipient <> '' THEN {_TOLD('recipient', recipient='recipient')} END, CASE WHEN wish <> '' THEN {_TOLD('wish', wish='wish')} END, CASE WHEN topic <> '' THEN {_TOLD('topic', topic='topic')} END, "
    f"{_TOLD('lines', num_lines='n')}, CASE WHEN len(keys) > 0 THEN {_TOLD('keywords', keywords=chr(97) + 'rray_to_string(keys, ' + S.q(', ') + ')')} END, CASE WHEN rhyme <> '' THEN {_TOLD('rhyme', rhyme='rhyme')} END], lambda x: x IS NOT NULL), chr(10))"
)
_TURNS = lambda system, user: f"'<|im_start|>system' || chr(10) || {S.q(pr.TEXTS[system])} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || {user} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"
_KEYLIST = "array_to_string(keys, ', ')"
_ASKED = f"""SELECT rec_no, text, CASE rec_no % 4 WHEN 0 THEN 'Ông bà' WHEN 1 THEN 'mọi người' WHEN 2 THEN '' END AS recipient, {S.squeeze("coalesce(title, '')")} AS wish, CASE WHEN rec_no % 5 > 0 THEN 'Tết' END AS topic, rec_no % 4 * 2 + 2 AS n,
['mai vàng', 'sum vầy', 'lộc biếc'][1 : rec_no % 4] AS keys, CASE WHEN rec_no % 2 = 0 THEN 'an' END AS rhyme, CASE WHEN rec_no % 3 = 0 THEN []::VARCHAR[] ELSE ['ông', 'bà'][1 : rec_no % 3] END AS people FROM {POEMS} WHERE text IS NOT NULL"""


def asked(spark, sf_dir) -> DataFrame:
    """Requests made of every poem: recipient, wish, topic, lines, keywords, rhyme and the people to be named."""
    n = F.col("rec_no")
    words = lambda ws, k: F.slice(F.array(*map(F.lit, ws)), F.lit(1), k.cast("int"))
    return table(spark, sf_dir, POEMS).where("text IS NOT NULL").select(
        "rec_no", "text", F.when(n % 4 == 0, "Ông bà").when(n % 4 == 1, "mọi người").when(n % 4 == 2, "").alias("recipient"), tx.squeeze(F.coalesce("title", F.lit(""))).alias("wish"), F.when(n % 5 > 0, "Tết").alias("topic"),
        (n % 4 * 2 + 2).alias("n"), words(["mai vàng", "sum vầy", "lộc biếc"], n % 4).alias("keys"), F.when(n % 2 == 0, "an").alias("rhyme"), words(["ông", "bà"], n % 3).alias("people"),
    )


@query(
    f"SELECT rec_no, md5({_PROMPT}) AS prompt, md5({_TURNS('poet', _PROMPT)}) AS chat, md5({_TOLD('gold', recipient=chr(67) + 'ASE WHEN recipient IN (' + S.q('mọi người') + ') THEN ' + S.q('mọi nhà') + ' ELSE recipient END', keywords=_KEYLIST, tone=S.q('Chân thành'))}) AS gold, md5({_TURNS('critic', _TOLD('critic_user', wish='wish', keywords=_KEYLIST, poem='text'))}) AS critic, md5({_TURNS('prose', _TOLD('prose_user', topic='topic'))}) AS prose, md5({_TURNS('plan', _TOLD('plan_user', poem='text'))}) AS plan FROM ({_ASKED})"
)
def prompt_texts(spark, sf_dir):
    """The prompts and chats made of every request: for a poem, a reviewed example, a critic, prose and a plan."""
    c = F.col
    keys = c("keys")
    chat = lambda turns: F.md5(pr.chat_text(turns))
    prompt = pr.poem_prompt(c("recipient"), c("wish"), c("topic"), c("n"), keys, c("rhyme"))
    return asked(spark, sf_dir).select(
        "rec_no", F.md5(prompt).alias("prompt"), chat(pr.messages("poet", prompt)).alias("chat"), F.md5(pr.gold_prompt(c("recipient"), keys, F.lit("Chân thành"))).alias("gold"),
        chat(pr.critic_messages(c("text"), c("wish"), keys)).alias("critic"), chat(pr.prose_messages(c("topic"))).alias("prose"), chat(pr.plan_messages(c("text"))).alias("plan"),
    )


_RETRY = _TOLD("failed", reasons=f"{_COVER} || '; ' || CASE WHEN rec_no % 2 = 0 THEN {S.q(pr.TEXTS['content_kept'])} ELSE {S.q(pr.TEXTS['content_missing'])} END || CASE WHEN rec_no % 3 = 0 THEN '; ' || {S.q(pr.TEXTS['form_first'])} ELSE '' END")
_REPAIR = f"CASE WHEN rec_no % 5 < 3 THEN {_TOLD('repair', issues=chr(67) + 'ASE WHEN rec_no % 5 = 0 THEN ' + S.q(pr.TEXTS['some_issue']) + ' ELSE ' + S.q('a; b; c; d') + ' END', repair=S.q('sửa'), poem='text')} END"
_CERTAIN = f"CASE WHEN rec_no % 7 > 0 THEN {_TOLD('certain', issues=S.fill(pr.TEXTS['orphan'], token=S.q('ơ')) + ' || ' + S.q('; ') + ' || ' + S.fill(pr.TEXTS['truncated'], keyword=S.q('mai vàng')))} END"


@query(f"SELECT rec_no, md5({_RETRY}) AS retry, md5({_REPAIR}) AS repair, md5(array_to_string(list_filter([{_RETRY}, {_CERTAIN}, {_REPAIR}], lambda x: x IS NOT NULL), chr(10))) AS strict FROM ({_ASKED})")
def feedback_texts(spark, sf_dir):
    """What the next attempt is told of the last one: by the gate, by a critic, and by certain errors."""
    c, n = F.col, F.col("rec_no")
    issues = F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, "abcde")))
    critic = F.struct(F.when(n % 5 < 3, "reject").otherwise("accept").alias("decision"), issues.alias("issues"), F.lit("sửa").alias("repair_instruction"))
    one = lambda kind, token, keyword: F.struct(F.lit(kind).alias("type"), F.lit(token).cast("string").alias("token"), F.lit(keyword).cast("string").alias("keyword"))
    certain = F.when(n % 7 > 0, F.array(one("orphan_vowel", "ơ", None), one("other", "x", None), one("truncated_keyword", None, "mai vàng")))
    rows = tx.settle(asked(spark, sf_dir), critic=critic, certain=certain)
    state = (c("people"), c("keys"), n % 2 == 0, n % 3 == 0)
    return rows.select("rec_no", F.md5(pr.retry_feedback(*state)).alias("retry"), F.md5(pr.repair_feedback(c("text"), c("critic"))).alias("repair"), F.md5(pr.strict_repair_feedback(*state, c("certain"), c("text"), c("critic"))).alias("strict"))


@query(f"SELECT rec_no, 'PLAN-' || lpad(row_number() OVER (ORDER BY rec_no)::VARCHAR, 3, '0') AS pilot_id FROM (SELECT rec_no FROM {MATERIAL} WHERE rec_no % 2 = 0 AND len(regexp_split_to_array(text, {S.q(T.LINE_END)})) >= 5 ORDER BY rec_no LIMIT 15)")
def plan_sources(spark, sf_dir):
    """The first fifteen full poems of five lines or more."""
    rows = table(spark, sf_dir, MATERIAL).withColumn("unit", F.when(F.col("rec_no") % 2 == 0, "raw_labeled_full_poem").otherwise("x"))
    return ag.plan_sources(rows, "rec_no", unit="unit").select("rec_no", "pilot_id")


_ATTEMPTS = f"SELECT (rec_no - 1) // 8 AS pool, (rec_no - 1) % 8 // 2 + 1 AS attempt, (rec_no - 1) % 8 AS idx, coalesce(metrics.rma, 0) AS score, coalesce(metrics.is_valid_lucbat, false) AND rec_no % 3 = 0 AS good FROM {WEB}"


@query(f"WITH c AS ({_ATTEMPTS}), l AS (SELECT pool, least(coalesce(min(attempt) FILTER (good), max(attempt)), 3) AS attempts FROM c GROUP BY pool) SELECT pool, attempts, count(*) AS candidates, bool_or(good) AS available, arg_min(idx, (good::INT * -1, -score, idx)) AS best FROM c JOIN l USING (pool) WHERE attempt <= attempts GROUP BY pool, attempts")
def retry_until_eligible(spark, sf_dir):
    """Pools of eight windows as four attempts of two, at most two after the first."""
    n = F.col("rec_no")
    rows = table(spark, sf_dir, WEB).select(F.expr("(rec_no - 1) DIV 8").alias("pool"), F.expr("(rec_no - 1) % 8 DIV 2 + 1").alias("attempt"), ((n - 1) % 8).alias("idx"), F.coalesce("metrics.rma", F.lit(0.0)).alias("score"), F.coalesce("metrics.is_valid_lucbat", F.lit(False)).alias("valid"), (n % 3 != 0).alias("hard_fail"))
    return ag.retried_until_eligible(rows, 2)


@query(f"SELECT pool, count(*) AS attempts, min(attempt) FILTER (ok AND NOT veto) AS accepted_at FROM (SELECT (rec_no - 1) // 8 AS pool, (rec_no - 1) % 8 + 1 AS attempt, coalesce(metrics.structure_ok, false) AS ok, rec_no % 4 = 0 AS veto FROM {WEB}) GROUP BY pool")
def accepted_attempts(spark, sf_dir):
    n = F.col("rec_no")
    rows = table(spark, sf_dir, WEB).select(F.expr("(rec_no - 1) DIV 8").alias("pool"), ((n - 1) % 8 + 1).alias("attempt"), F.coalesce("metrics.structure_ok", F.lit(False)).alias("accepted"), F.when(n % 4 == 0, True).alias("vetoed"))
    return ag.accepted_attempts(rows)


@query(
    f"SELECT id, fault FROM (SELECT rec_no AS id, CASE WHEN rec_no % 11 = 0 THEN 'split' WHEN t = '' THEN 'prompt' WHEN w = '' THEN 'wish_intent' WHEN rec_no % 7 = 0 THEN 'recipient' WHEN rec_no % 5 = 0 THEN 'keywords' WHEN rec_no % 3 = 0 THEN 'num_lines' END AS fault FROM (SELECT rec_no, {S.squeeze("coalesce(title, '')")} AS t, {S.squeeze("coalesce(url, '')")} AS w FROM {POEMS})) WHERE fault IS NOT NULL"
)
def manifest_faults(spark, sf_dir):
    """The first fault of each prompt of a manifest made of every poem; the protocol's metadata are checked with it."""
    n = F.col("rec_no")
    rows = table(spark, sf_dir, POEMS).select(
        n.alias("id"), F.col("title").alias("prompt"), F.col("url").alias("wish_intent"), F.when(n % 7 == 0, " ").when(n % 2 == 0, "bà").alias("recipient"), F.when(n % 5 == 0, F.array(F.lit("một"), F.lit(" MỘT"))).otherwise(F.array(F.lit("một"), F.lit("hai"))).alias("keywords"),
        F.when(n % 3 == 0, 6).otherwise(4).alias("num_lines"), F.lit(None).cast("string").alias("protocol_version"),
    )
    return ag.manifest_faults(rows, F.lit("tet4-v1"), F.when(F.col("id") % 11 == 0, "dev").otherwise("test"), "test")


@query(f"SELECT CASE WHEN rec_no % 5 = 0 THEN 'tie' WHEN (rec_no % 2 = 0) = (rec_no % 3 = 0) THEN 'left' ELSE 'right' END AS winner, count(*) AS n FROM {POEMS} GROUP BY 1")
def paired_tally(spark, sf_dir):
    rows = table(spark, sf_dir, POEMS).select("rec_no")
    preference = F.when(F.col("rec_no") % 5 == 0, "TIE").when(F.col("rec_no") % 2 == 0, "A").otherwise("B")
    ratings = rows.select(F.col("rec_no").alias("pair_id"), preference.alias("preference"))
    left = F.col("rec_no") % 3 == 0
    key = rows.select(F.col("rec_no").alias("pair_id"), F.when(left, "left").otherwise("right").alias("a_is"), F.when(left, "right").otherwise("left").alias("b_is"))
    return au.paired_tally(ratings, key)


_CLEAN = f"coalesce(array_to_string(list_filter(list_transform(regexp_split_to_array(nfc_normalize(coalesce(text, '')), '\\r\\n|\\r|\\n'), lambda x: {S.strip(chr(114) + 'egexp_replace(translate(x, ' + S.q('()' + chr(34) + '“”*') + ', ' + chr(39) * 2 + '), ' + S.q('[ ' + chr(92) + 't]+') + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}), lambda x: x <> ''), chr(10)), '')"


@query(
    f"SELECT reason, count(*) AS n FROM (SELECT coalesce(r, CASE WHEN row_number() OVER (PARTITION BY r IS NULL, p ORDER BY rec_no) > 1 THEN 'exact_duplicate_after_cleaning' END, 'accepted') AS reason FROM (SELECT rec_no, p, CASE WHEN rec_no % 4 = 0 THEN 'human_reject_or_unselected' WHEN rec_no % 9 = 0 THEN 'metadata:recipient' WHEN rec_no % 7 = 0 THEN 'metadata:keywords' WHEN rec_no % 11 = 0 THEN 'metadata:tone' WHEN p = '' THEN 'metadata:poem' END AS r FROM (SELECT rec_no, {_CLEAN} AS p FROM {MATERIAL}))) GROUP BY 1"
)
def gold_import(spark, sf_dir):
    """Materials as reviewed rows: the first reason against each, duplicates among what passes."""
    n = F.col("rec_no")
    rows = table(spark, sf_dir, MATERIAL).select(
        "rec_no", F.col("text").alias("poem"), F.when(n % 4 == 0, "reject").otherwise(" accept ").alias("decision"), F.when(n % 9 == 0, " ").otherwise("chung chung").alias("recipient"),
        F.when(n % 7 == 0, "mai vàng|Mai vàng").otherwise("mai vàng| sum vầy").alias("keywords_pipe"), F.when(n % 11 == 0, "khác").otherwise("Chân thành").alias("tone"),
    )
    found = au.gold_import(rows, "rec_no")
    return found.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def sequences(spark, sf_dir) -> DataFrame:
    groups = ln.rhyme_dictionary(ln.rhyme_pairs(poem_couplets(spark, sf_dir)))
    vocabulary = groups.select(F.explode("words").alias("syllable")).distinct()
    return tr.attributed(tr.spelled(vocabulary), groups)


_VOCAB = f"SELECT DISTINCT unnest(words) AS s FROM ({_DICT})"
_GID = f"SELECT rhyme, row_number() OVER (ORDER BY rhyme) - 1 AS gid FROM (SELECT DISTINCT rhyme FROM ({_DICT}))"
_SEQ = f"SELECT v.s, v.root, v.tk, CASE {S.tone('v.s')} WHEN 'ngang' THEN 1 WHEN 'huyền' THEN 2 WHEN 'unknown' THEN 0 ELSE 4 END AS bit, g.gid FROM (SELECT s, 0 AS root, string_split(s, '') AS tk FROM ({_VOCAB}) UNION ALL SELECT s, 1, list_concat([' '], string_split(s, '')) FROM ({_VOCAB})) v LEFT JOIN ({_GID}) g ON g.rhyme = {S.rhyme('v.s')} WHERE {S.syllable('v.s')}"


@query(f"SELECT root, array_to_string(tk[:d], chr(1)) AS path, CAST(bit_or(bit) AS INT) AS tone_bits, array_to_string(list_sort(list(DISTINCT gid)), ',') AS gids, bool_or(d = len(tk)) AS complete FROM (SELECT *, unnest(range(1, len(tk) + 1)) AS d FROM ({_SEQ})) GROUP BY 1, 2")
def trie_nodes(spark, sf_dir):
    rows = tr.nodes(sequences(spark, sf_dir))
    return rows.select("root", "path", "tone_bits", F.array_join("gids", ",").alias("gids"), "complete")


@query(f"SELECT token, CAST(bit_or(bit) AS INT) AS tone_bits, coalesce(array_to_string(list_sort(list(DISTINCT gid) FILTER (gid IS NOT NULL)), ','), '') AS gids FROM (SELECT unnest(list_distinct(tk)) AS token, bit, gid FROM ({_SEQ})) GROUP BY 1")
def token_masks(spark, sf_dir):
    return tr.token_masks(sequences(spark, sf_dir)).select("token", "tone_bits", F.array_join("gids", ",").alias("gids"))


_NODES = f"SELECT root, array_to_string(tk[:d], chr(1)) AS path, array_to_string(tk[: d - 1], chr(1)) AS parent, tk[d] AS token, bit_or(bit) AS bits, list(DISTINCT gid) FILTER (gid IS NOT NULL) AS gids, bool_or(d = len(tk)) AS complete FROM (SELECT *, unnest(range(1, len(tk) + 1)) AS d FROM ({_SEQ})) GROUP BY ALL"
_STATES = """SELECT root || ':' || path AS state, root, path, complete, CASE WHEN length(path) % 2 = 0 THEN 'luc' ELSE 'bat' END AS line, length(path) % 5 + 4 AS word_pos, CASE WHEN length(path) % 7 = 3 THEN 2 END AS stop, length(path) % 4 AS couplets, length(path) % 13 = 12 AS finished, length(path) % 2 = 0 AS after_bat,
CASE length(path) % 3 WHEN 0 THEN 7 WHEN 1 THEN 3 ELSE 4 END AS tones, CASE WHEN length(path) % 5 = 1 THEN [0, 3, 5, 8] END AS gids, 3 AS next_tones, CASE WHEN length(path) % 4 = 2 THEN [1, 2] END AS next_gids FROM (SELECT root, path, complete FROM n UNION ALL SELECT 0, '', false UNION ALL SELECT 1, '', false)"""
_FORCED = "CASE WHEN finished THEN 'end' WHEN complete AND ((line = 'luc' AND word_pos = 6) OR (line = 'bat' AND word_pos = 8)) THEN 'line' WHEN couplets >= stop THEN 'end' END"


@query(
    f"""WITH n AS MATERIALIZED ({_NODES}), s AS MATERIALIZED (SELECT *, {_FORCED} AS forced FROM ({_STATES})),
w AS (SELECT state, root, path, 'walk' AS kind, tones AS t, gids AS g FROM s WHERE forced IS NULL UNION ALL SELECT state, 1, '', 'begin', next_tones, next_gids FROM s WHERE forced IS NULL AND complete),
c AS (SELECT w.state, w.kind, n.token, (n.bits & w.t) <> 0 AND (w.g IS NULL OR list_has_any(n.gids, w.g)) OR (w.t = 7 AND w.g IS NULL) AS ok FROM w JOIN n ON n.root = w.root AND n.parent = w.path), k AS (SELECT *, coalesce(ok, false) AS fine, bool_or(coalesce(ok, false)) OVER (PARTITION BY state) AS met FROM c)
SELECT state, token, max(kind) AS kind, bool_or(NOT met) AS relaxed FROM k WHERE fine OR NOT met GROUP BY state, token UNION ALL SELECT state, NULL, forced, false FROM s WHERE forced IS NOT NULL UNION ALL SELECT state, NULL, 'end', false FROM s WHERE forced IS NULL AND path = '' AND root = 0 AND stop IS NULL AND after_bat"""
)
def decode_allowed(spark, sf_dir):
    """What a strict decoder would allow at every node of the trie, with the states that end and those that are relaxed."""
    nodes = cut(tr.nodes(sequences(spark, sf_dir)), "nodes")
    return decode.allowed_set(decode_states(nodes), nodes).drop("penalty")


def decode_states(nodes: DataFrame) -> DataFrame:
    """Every node and both roots as a state whose place and constraints follow from the length of its path."""
    n = F.length("path")
    roots = nodes.sparkSession.createDataFrame([(0, ""), (1, "")], "root int, path string")
    groups = lambda k, of, ids: F.when(n % k == of, F.array(*[F.lit(i) for i in ids]))
    return nodes.select("root", "path").union(roots).select(
        F.concat(F.col("root").cast("string"), F.lit(":"), "path").alias("state"), "root", "path", F.when(n % 2 == 0, "luc").otherwise("bat").alias("line"), (n % 5 + 4).alias("word_pos"), F.when(n % 7 == 3, 2).alias("stop"), (n % 4).alias("couplets"),
        (n % 13 == 12).alias("finished"), (n % 2 == 0).alias("after_bat"), F.when(n % 3 == 0, 7).when(n % 3 == 1, 3).otherwise(4).alias("tones"), groups(5, 1, [0, 3, 5, 8]).alias("groups"), F.lit(3).alias("next_tones"), groups(4, 2, [1, 2]).alias("next_groups"),
    )


@query(f"SELECT a.rhyme, {S.kind('a.rhyme', 'b.rhyme')} AS kind, b.rhyme AS other FROM ({_DICT}) a, ({_DICT}) b WHERE {S.kind('a.rhyme', 'b.rhyme')} IS NOT NULL")
def rhyme_group_match(spark, sf_dir):
    groups = ln.rhyme_dictionary(ln.rhyme_pairs(poem_couplets(spark, sf_dir)))
    return tr.matching_groups(groups, groups)


@query(f"SELECT w AS id, CAST(length(w) AS BIGINT) AS steps, w IN (SELECT s FROM ({_VOCAB}) WHERE {S.syllable('s')}) AS allowed FROM (SELECT DISTINCT tk[-1] AS w FROM ({S.line_table(WEB, 'rec_no')}))")
def decode_verify(spark, sf_dir):
    """Line ends as token sequences: does the trie of the rhyme dictionary allow each step and the end?"""
    ends = ln.line_table(table(spark, sf_dir, WEB), "rec_no").select(F.element_at("tk", -1).alias("id")).distinct()
    rows = ends.select("id", F.lit(0).alias("root"), F.filter(F.split("id", ""), lambda c: c != "").alias("tokens"))
    return tr.verify(rows, tr.nodes(sequences(spark, sf_dir)))


_WIN = f"SELECT id, pos, win, sha256(lower({S.strip('translate(nfc_normalize(win), chr(13), ' + chr(39) * 2 + ')')})) AS fp FROM ({_GATED})"
_NO_ORPHAN = f"len(list_filter({S.words('nfc_normalize(text)')}, lambda t: list_contains({S.array(T.ORPHAN_VOWELS)}, t))) = 0"
_SELECTED = f"""w0 AS MATERIALIZED ({_WIN}), w1 AS MATERIALIZED (SELECT id * 1000000 + pos AS key, id AS page, pos AS spot, win AS text, fp FROM w0 QUALIFY row_number() OVER (PARTITION BY id, fp ORDER BY pos) = 1),
w2 AS MATERIALIZED (SELECT w1.page, w1.spot, w1.fp, concat_ws(',', CASE WHEN q.rma < 50 THEN 'low_rhyme_score' END, CASE WHEN q.tcr < 70 THEN 'low_tone_score' END) AS reason FROM w1 JOIN {eval_sql('w1', 'key', 'CAST(4 AS INT)')} q ON q.id = w1.key WHERE q.structure_ok AND {_NO_ORPHAN.replace('text', 'w1.text')}),
w3 AS (SELECT page, unnest(list_reduce(list_transform(list_sort(list(spot)), lambda o: [o]), lambda x, y: CASE WHEN y[1] >= x[-1] + 4 THEN list_concat(x, y) ELSE x END)) AS spot FROM w2 GROUP BY page),
w4 AS (SELECT page, spot, fp, reason, CASE WHEN reason = '' THEN 'accepted' ELSE 'review' END AS bucket FROM w2 JOIN w3 USING (page, spot)), w5 AS (SELECT * FROM w4 QUALIFY row_number() OVER (PARTITION BY fp, bucket ORDER BY page, spot) = 1),
kept AS (SELECT w5.page, w5.spot, w5.fp, w5.bucket, w5.reason FROM w5 LEFT JOIN (SELECT fp, page AS first FROM w5 WHERE bucket = 'accepted') f USING (fp) WHERE bucket = 'accepted' OR first IS NULL OR first > page)"""


@query(f"WITH {_SELECTED} SELECT page AS id, spot AS pos, fp AS fingerprint, bucket, reason AS review_reason FROM kept")
def page_select(spark, sf_dir):
    """Documents as pages: season windows judged, overlaps and repeats dropped, accepted or for review."""
    return web.select_windows(gated_windows(spark, sf_dir))


_TOKENS = f"SELECT id, unnest(a) AS tok, generate_subscripts(a, 1) - 1 AS i FROM (SELECT rec_no AS id, string_split(lower(regexp_replace(nfc_normalize(text), '[^\\p{{L}}\\n ]+', '', 'g')), '') AS a FROM {WEB} WHERE text IS NOT NULL) WHERE a <> ['']"
_STEPPED = f"""t0 AS (SELECT id, i, tok, tok IN (' ', chr(10)) AS cut FROM ({_TOKENS})), t1 AS (SELECT *, sum(cut::INT) OVER (PARTITION BY id ORDER BY i)::BIGINT AS g FROM t0),
t2 AS (SELECT *, (first_value(tok) OVER h = ' ')::INT AS root, array_to_string(list_filter(list(tok) OVER h, lambda x: x <> chr(10)), chr(1)) AS walked, array_to_string(list_filter(list(tok) OVER (PARTITION BY id, g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), lambda x: x NOT IN (' ', chr(10))), '') AS syl FROM t1 WINDOW h AS (PARTITION BY id, g ORDER BY i)),
t3 AS MATERIALIZED (SELECT *, lag(walked) OVER p AS before, lag(root) OVER p AS before_root FROM t2 WINDOW p AS (PARTITION BY id ORDER BY i))"""


def characters(spark, sf_dir) -> DataFrame:
    """Every window as a sequence of characters."""
    clean = F.lower(F.regexp_replace(tx.nfc(F.col("text")), r"[^\p{L}\n ]+", ""))
    return table(spark, sf_dir, WEB).where("text IS NOT NULL").select(F.col("rec_no").alias("id"), F.filter(F.split(clean, ""), lambda c: c != "").alias("tokens"))


@query(f"WITH {_STEPPED} SELECT id, i, g AS syllable_no, root, md5(coalesce(before, '')) AS before, syl AS syllable FROM t3")
def decode_steps(spark, sf_dir):
    """The state of a decoder before each character of each window."""
    rows = decode.steps(characters(spark, sf_dir))
    return rows.select("id", F.col("i").cast("long").alias("i"), F.col("syllable_no").cast("long").alias("syllable_no"), "root", F.md5(F.coalesce("before", F.lit(""))).alias("before"), "syllable")


_BANG_OF = lambda x: f"{x} IN ('ngang', 'huyền')"


@query(
    f"""WITH {_STEPPED}, nd AS (SELECT root, array_to_string(tk[:d], chr(1)) AS path, bool_or(d = len(tk)) AS complete FROM (SELECT *, unnest(range(1, len(tk) + 1)) AS d FROM ({_SEQ})) GROUP BY 1, 2),
s0 AS (SELECT DISTINCT id, g, syl FROM t3), s1 AS (SELECT id, g, syl, lag(syl, 2) OVER o AS b2, lag(syl, 6) OVER o AS b6, g % 14 AS p FROM s0 WINDOW o AS (PARTITION BY id ORDER BY g)),
s2 AS (SELECT *, {S.tone('syl')} AS t, CASE WHEN b2 IS NOT NULL THEN {S.tone('b2')} END AS t2 FROM s1),
s3 AS (SELECT id, g, (CASE WHEN CASE WHEN p IN (1, 5, 7, 11) THEN NOT {_BANG_OF('t')} WHEN p IN (3, 9) THEN {_BANG_OF('t')} WHEN p = 13 THEN CASE WHEN t2 = 'ngang' THEN t <> 'huyền' WHEN t2 = 'huyền' THEN t <> 'ngang' ELSE NOT {_BANG_OF('t')} END ELSE false END THEN 1.5 ELSE 0 END + CASE WHEN p IN (5, 11) AND b6 IS NOT NULL AND {S.kind(S.rhyme('b6'), S.rhyme('syl'))} IS NULL THEN 3.0 ELSE 0 END)::DOUBLE AS cost FROM s2),
a0 AS (SELECT t3.id, t3.g, t3.i, t3.tok, t3.cut, a.path IS NOT NULL AS node, coalesce(b.complete, false) AS ended, (t3.g % 14 IN (6, 0) AND t3.g > 0) AS line_end FROM t3 LEFT JOIN nd a ON a.root = t3.root AND a.path = t3.walked LEFT JOIN nd b ON b.root = t3.before_root AND b.path = t3.before)
SELECT a0.id, count(*) AS steps, count(*) FILTER ((node OR tok = chr(10)) AND (NOT cut OR ended) AND CASE WHEN tok = chr(10) THEN line_end WHEN tok = ' ' THEN NOT line_end ELSE true END) AS allowed, any_value(c.penalty) AS penalty FROM a0 JOIN (SELECT id, sum(cost) AS penalty FROM s3 GROUP BY id) c USING (id) GROUP BY a0.id"""
)
def decode_trace(spark, sf_dir):
    """Every window as a sequence of characters: what a decoder over the rhyme dictionary would have
    allowed, and the penalties of its tones and rhymes, summed by window."""
    found = decode.traced(characters(spark, sf_dir), tr.nodes(sequences(spark, sf_dir)))
    return found.groupBy("id").agg(F.count("*").alias("steps"), F.sum(F.col("allowed").cast("long")).alias("allowed"), F.sum("penalty").alias("penalty"))


_GROUPS = f"SELECT id AS grp, list(line ORDER BY pos) AS a, count(*) AS n FROM ({_DOC_LINES}) GROUP BY id"


@query(
    f"""WITH RECURSIVE g0 AS MATERIALIZED ({_GROUPS}), v0 AS MATERIALIZED (SELECT grp * 1000000 + k AS key, grp, k AS pos, array_to_string(a[k + 1 : k + 4], chr(10)) AS text FROM (SELECT grp, a, unnest(range(0, n - 3)) AS k FROM g0 WHERE n >= 4)),
v1 AS MATERIALIZED (SELECT v0.*, q.structure_ok AS sound, NOT ({_NO_ORPHAN.replace('text', 'v0.text')}) AS bad, q.tcr >= 70 AND q.rma >= 50 AS good FROM v0 JOIN {eval_sql('v0', 'key', 'CAST(4 AS INT)')} q ON q.id = v0.key),
v2 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY grp, pos) AS n, grp, pos, good, sha256(lower(nfc_normalize(text))) AS digest FROM v1 WHERE sound AND NOT bad),
f AS (SELECT 0::BIGINT AS n, -1::BIGINT AS grp, -9::BIGINT AS last, []::VARCHAR[] AS seen, '' AS state, false AS good UNION ALL SELECT v2.n, v2.grp, CASE WHEN v2.grp = f.grp AND v2.pos < f.last + 4 OR list_contains(f.seen, v2.digest) THEN CASE WHEN v2.grp = f.grp THEN f.last ELSE -9 END ELSE v2.pos END,
CASE WHEN v2.grp = f.grp AND v2.pos < f.last + 4 OR list_contains(f.seen, v2.digest) THEN f.seen ELSE list_append(f.seen, v2.digest) END, CASE WHEN v2.grp = f.grp AND v2.pos < f.last + 4 THEN 'overlap' WHEN list_contains(f.seen, v2.digest) THEN 'repeat' ELSE 'taken' END, v2.good FROM f JOIN v2 ON v2.n = f.n + 1)
SELECT (SELECT count(*) FROM g0) AS source_groups, (SELECT count(*) FROM g0 WHERE n = 2) AS two_line_units, (SELECT count(*) FROM g0 WHERE n < 4) AS under_four_lines, (SELECT count(*) FROM v1) AS windows_scanned, (SELECT count(*) FROM v1 WHERE sound) AS structure_ok_windows, (SELECT count(*) FROM v1 WHERE sound AND bad) AS lexical_rejected,
count(*) FILTER (state = 'overlap') AS overlap_rejected, count(*) FILTER (state = 'repeat') AS exact_duplicates, count(*) FILTER (state = 'taken' AND good) AS strict_records, count(*) FILTER (state = 'taken' AND NOT good) AS review_records FROM f"""
)
def manual_import(spark, sf_dir):
    """Every document as a pasted group: what the import counts, windows that repeat earlier ones left free."""
    rows = ln.rendered_lines(table(spark, sf_dir, DOCS), "doc_id")
    groups = rows.groupBy(F.col("id").alias("grp")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("lines"))
    return web.manual_import(groups)[2]


@query(f"WITH {_SELECTED}, l AS (SELECT id, count(*) AS n FROM ({_DOC_LINES}) GROUP BY id), s AS (SELECT id, count(*) AS n FROM w0 GROUP BY id), k AS (SELECT page AS id, count(*) FILTER (bucket = 'accepted') AS accepted, count(*) FILTER (bucket = 'review') AS review FROM kept GROUP BY page) SELECT count(*) AS pages, sum(l.n)::BIGINT AS rendered_lines, coalesce(sum(s.n), 0)::BIGINT AS scanned_windows, coalesce(sum(accepted), 0)::BIGINT AS accepted, coalesce(sum(review), 0)::BIGINT AS review, count(*) FILTER (coalesce(accepted + review, 0) = 0) AS empty_pages FROM l LEFT JOIN s USING (id) LEFT JOIN k USING (id)")
def crawl_audit(spark, sf_dir):
    """Documents as pages: the totals of a crawl."""
    rows = ln.rendered_lines(table(spark, sf_dir, DOCS), "doc_id")
    windows = cut(gated_windows(spark, sf_dir), "windows")
    return web.crawl_totals(web.page_audit(rows, windows, web.select_windows(windows)))


@query(
    f"""WITH n AS MATERIALIZED ({_NODES}), mk AS (SELECT token, bit_or(bit) AS mb, coalesce(list(DISTINCT gid) FILTER (gid IS NOT NULL), []) AS mg FROM (SELECT unnest(list_distinct(tk)) AS token, bit, gid FROM ({_SEQ})) GROUP BY 1), s AS MATERIALIZED (SELECT *, {_FORCED} AS forced FROM ({_STATES})),
w AS (SELECT state, root, path, 'walk' AS kind, tones AS t, gids AS g, path = '' AS first FROM s WHERE forced IS NULL UNION ALL SELECT state, 1, '', 'begin', next_tones, next_gids, true FROM s WHERE forced IS NULL AND complete),
c AS (SELECT w.state, n.token, CASE WHEN first THEN CASE WHEN w.t <> 7 AND mk.mb & w.t = 0 THEN 1.5 ELSE 0 END + CASE WHEN w.g IS NOT NULL AND NOT list_has_any(mk.mg, w.g) THEN 3.0 ELSE 0 END ELSE 0 END::DOUBLE AS penalty FROM w JOIN n ON n.root = w.root AND n.parent = w.path JOIN mk USING (token))
SELECT state, token, max(penalty) AS penalty FROM c GROUP BY state, token"""
)
def decode_soft(spark, sf_dir):
    """What the first tokens of syllables would cost a soft decoder at every node of the trie."""
    rows = cut(sequences(spark, sf_dir), "sequences")
    nodes = cut(tr.nodes(rows), "nodes")
    found = decode.allowed_set(decode_states(nodes), nodes, tr.token_masks(rows), strict=False)
    return found.where("token IS NOT NULL").select("state", "token", "penalty")


@query(
    f"SELECT rec_no, CASE WHEN rec_no % 3 = 0 THEN 'Chúc ' || r || ': ' || w ELSE w END AS wish, CASE WHEN lower(w) = 'xuân' OR w = '' THEN 'xuân' ELSE coalesce(nullif(w, ''), '') || '|xuân' END AS keywords, CASE WHEN w = '' THEN 'wish_intent' WHEN rec_no % 3 = 0 AND r = '' THEN 'recipient' WHEN lower(w) = 'xuân' THEN 'keywords' END AS fault FROM (SELECT rec_no, {S.squeeze('coalesce(title, ' + chr(39) * 2 + ')')} AS w, {S.squeeze('coalesce(source_id, ' + chr(39) * 2 + ')')} AS r FROM {POEMS})"
)
def metadata_normal(spark, sf_dir):
    """The protocol's metadata made of titles and sources: wish, keywords of different spellings, first fault."""
    n, title = F.col("rec_no"), F.col("title")
    keys = F.array(title, F.lit(" xuân "), F.lit("XUÂN"), F.lit(" "))
    m = ag.normalize_metadata(title, F.when(n % 3 == 0, F.coalesce("source_id", F.lit(""))), F.filter(keys, lambda k: k.isNotNull()), F.lit(4), F.lit("tet4-v1"))
    rows = tx.settle(table(spark, sf_dir, POEMS).select("rec_no", "title", "source_id"), m=m)
    return rows.select("rec_no", F.col("m.wish_intent").alias("wish"), F.array_join("m.keywords", "|").alias("keywords"), F.col("m.fault").alias("fault"))


@query(f"SELECT note, CASE WHEN v IN ('A', 'B', 'TIE') THEN v WHEN regexp_matches(v, '^A[^A-Z0-9]') THEN 'A' WHEN regexp_matches(v, '^B[^A-Z0-9]') THEN 'B' END AS choice, count(*) AS n FROM (SELECT note, upper({S.strip('note')}) AS v FROM (SELECT [' a ', 'B', 'tie', 'A: ', 'b)', 'A1', 'bc '][rec_no % 7 + 1] || CASE WHEN rec_no % 7 IN (3, 4) THEN coalesce(title, '') ELSE '' END AS note FROM {POEMS})) GROUP BY ALL")
def choices(spark, sf_dir):
    """Reviewers' notes, some with a title behind the letter, as choices."""
    n = (F.col("rec_no") % 7).cast("int")
    note = F.concat(F.get(F.array(*map(F.lit, [" a ", "B", "tie", "A: ", "b)", "A1", "bc "])), n), F.when(n.isin(3, 4), F.coalesce("title", F.lit(""))).otherwise(""))
    return table(spark, sf_dir, POEMS).select(note.alias("note")).groupBy("note", au.choice(F.col("note")).alias("choice")).agg(F.count("*").alias("n"))


@query(f"SELECT rec_no, CASE WHEN text IS NOT NULL AND len(a) = 4 THEN md5(array_to_string(a, '|')) END AS plan FROM (SELECT rec_no, text, string_split(text, chr(10)) AS a FROM {POEMS})")
def loose_plan(spark, sf_dir):
    """Plans whose lines are plain sentences, one for each line of a text; only those of four are plans."""
    plan = F.struct(*[F.lit("x").alias(k) for k in ("recipient", "wish_intent")], F.array(F.lit("a")).alias("keywords"), F.array(F.lit("b")).alias("imagery"), F.lit("t").alias("tone"), F.split("text", "\n").alias("line_plan"))
    raw = F.concat(F.lit("```json\n"), F.to_json(plan), F.lit("\n```"))
    rows = tx.settle(table(spark, sf_dir, POEMS).select("rec_no", "text"), p=F.when(F.col("text").isNotNull(), ag.parse_loose_plan(raw)))
    return rows.select("rec_no", F.md5(F.array_join("p.line_plan", "|")).alias("plan"))


@query(f"SELECT rec_no, CASE WHEN lower(CASE WHEN lower(r) = 'chung chung' THEN 'mọi nhà' ELSE r END) IN ('mọi nhà', 'mọi người') THEN 'general' ELSE 'specific_or_group' END AS scope FROM (SELECT rec_no, ['Chung chung', ' Mọi  người', 'ông bà', 'MỌI NHÀ', ''][rec_no % 5 + 1] AS r0, regexp_replace({S.strip('[' + chr(39) + 'Chung chung' + chr(39) + ', ' + chr(39) + ' Mọi  người' + chr(39) + ', ' + chr(39) + 'ông bà' + chr(39) + ', ' + chr(39) + 'MỌI NHÀ' + chr(39) + ', ' + chr(39) * 2 + '][rec_no % 5 + 1]')}, '[ \\t]+', ' ', 'g') AS r FROM {MATERIAL})")
def recipient_scopes(spark, sf_dir):
    """Whom reviewed rows are addressed to."""
    to = F.get(F.array(*map(F.lit, ["Chung chung", " Mọi  người", "ông bà", "MỌI NHÀ", ""])), (F.col("rec_no") % 5).cast("int"))
    rows = table(spark, sf_dir, MATERIAL).select("rec_no", F.col("text").alias("poem"), F.lit("accept").alias("decision"), to.alias("recipient"), F.lit("một|hai").alias("keywords_pipe"), F.lit("Chân thành").alias("tone"))
    return au.gold_import(rows, "rec_no").select("rec_no", F.col("recipient_scope").alias("scope"))


_TOKENS_OF = f"len(list_filter(regexp_split_to_array(text, {S.q(T.WS + '+')}), lambda w: w <> ''))"


@query(f"WITH d AS (SELECT text, {_SIG} AS s FROM {DOCS} WHERE text IS NOT NULL), k AS (SELECT text, {_TOKENS_OF} AS n FROM d WHERE list_contains(s, 'tet_direct') OR (list_contains(s, 'spring_explicit') AND list_contains(s, 'reunion'))) SELECT count(*) AS records, count(DISTINCT text) AS unique_records, sum(n)::BIGINT AS tokens, (SELECT sum(n)::BIGINT FROM (SELECT DISTINCT text, n FROM k)) AS unique_tokens FROM k")
def domain_stats(spark, sf_dir):
    """Documents of the domain: records and tokens before and after equal texts are folded."""
    rows = table(spark, sf_dir, DOCS).where("text IS NOT NULL").select("text", ag.signals(F.col("text")).alias("s")).where(ag.in_domain(F.col("s")))
    return ag.domain_stats(rows, "text")


@query(
    f"SELECT w AS word, {S.tone('w')} AS tone, {S.rhyme('w')} AS rhyme, {S.syllable('w')} AS valid, CASE {S.tone('w')} WHEN 'ngang' THEN 0 WHEN 'huyền' THEN 1 WHEN 'unknown' THEN NULL ELSE 2 END AS bit, {S.kind(S.rhyme('w'), S.rhyme(S.q('xuân')))} AS kind FROM (SELECT DISTINCT w FROM {_words_of(DOCS)})"
)
def sql_functions(spark, sf_dir):
    """The words of all documents through the functions of the SQL surface."""
    registry.register(spark)
    token_column(table(spark, sf_dir, DOCS)).distinct().createOrReplaceTempView("versemill_words")
    return spark.sql("SELECT w AS word, lb_tone(w) AS tone, lb_rhyme(w) AS rhyme, lb_is_syllable(w) AS valid, lb_tone_bit(w) AS bit, lb_rhyme_kind(w, 'xuân') AS kind FROM versemill_words")


@query(f"SELECT rec_no, count(*) AS n, md5(min(win)) AS least FROM (SELECT rec_no, k, array_to_string(a[k : k + 3], chr(10)) AS win FROM (SELECT rec_no, string_split(text, chr(10)) AS a, unnest(range(1, len(string_split(text, chr(10))) - 2)) AS k FROM {POEMS} WHERE text IS NOT NULL)) GROUP BY rec_no")
def sql_windows(spark, sf_dir):
    """Windows of four lines by the table function of the SQL surface."""
    registry.register(spark)
    table(spark, sf_dir, POEMS).createOrReplaceTempView("versemill_poems")
    return spark.sql("SELECT rec_no, count(*) AS n, md5(min(w.window)) AS least FROM versemill_poems, LATERAL lb_windows(text, 4) w WHERE text IS NOT NULL GROUP BY rec_no")


@query(f"WITH {_STEPPED}, k AS (SELECT DISTINCT unnest(tk) AS token FROM ({_SEQ})) SELECT tok AS token, CASE WHEN tok IN (SELECT token FROM k) THEN 'text of ' || tok ELSE '' END AS text FROM (SELECT DISTINCT tok FROM t0)")
def token_texts(spark, sf_dir):
    """The characters of all windows by the table of the dictionary's characters; those outside it have no text."""
    tokens = characters(spark, sf_dir).select(F.explode("tokens").alias("token")).distinct()
    known = sequences(spark, sf_dir).select(F.explode("tokens").alias("token")).distinct()
    return decode.token_texts(tokens, known.withColumn("text", F.concat(F.lit("text of "), "token")))
