"""Queries on scores, gates, traces, lexical checks and collocation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.functions import tables as T
from versemill.functions import text as tx
from versemill.operators import collocation as co
from versemill.operators import evaluate as ev
from versemill.operators import lexical as lx
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


def eval_sql(source: str, key: str, expected: str = "CAST(NULL AS INT)", extra: str = "") -> str:
    """A query for the metrics of each poem (id, ex, scr, ..., errors, kinds) of a table or query `source`."""
    t = lambda k: f"coalesce(tk[{k}], '')"
    yes = lambda c: f"CAST({c} AS INT)"
    last = f"(CASE {S.tone(t(6))} WHEN 'huyền' THEN {S.tone(t(8))} = 'ngang' WHEN 'ngang' THEN {S.tone(t(8))} = 'huyền' ELSE {S.bang(t(8))} END)"
    first = f"{yes(S.bang(t(2)))} + {yes(S.trac(t(4)))} + {yes(S.bang(t(6)))}"
    keep = f", {extra}" if extra else ""
    return f"""(
WITH b AS (SELECT {key} AS id, {expected} AS ex{keep} FROM {source} WHERE text IS NOT NULL),
m AS (SELECT id, pos, len(tk) AS n, CASE len(tk) WHEN 6 THEN {first} WHEN 8 THEN {first} + {yes(last)} ELSE 0 END AS c, CASE len(tk) WHEN 6 THEN 3 WHEN 8 THEN 4 ELSE 0 END AS md, {S.rhyme('tk[6]')} AS r6, {S.rhyme('tk[8]')} AS r8 FROM ({S.line_table(source, key)})),
j AS (SELECT b.id, b.ex, m.pos, m.n, m.c, m.md, m.r6, m.r8, count(m.pos) OVER (PARTITION BY b.id) AS nl, lead(m.r6) OVER (PARTITION BY b.id ORDER BY m.pos) AS nr FROM b LEFT JOIN m USING (id)),
k AS (SELECT *, coalesce(pos < coalesce(ex, 1000000000) AND NOT (ex IS NULL AND nl % 2 = 1 AND pos = nl - 1) AND n = CASE WHEN pos % 2 = 0 THEN 6 ELSE 8 END, false) AS good, coalesce({S.kind('(CASE WHEN pos % 2 = 0 THEN r6 ELSE r8 END)', 'nr')}, 'mismatch') AS kd FROM j),
a AS (SELECT id, any_value(ex) AS ex, any_value(nl) AS nl, count(*) FILTER (good) AS gl, coalesce(sum(c), 0) AS c, coalesce(sum(md), 0) AS md, list('line_' || (pos + 1) || '_expected_' || (CASE WHEN pos % 2 = 0 THEN 6 ELSE 8 END) ORDER BY pos) FILTER (NOT good AND pos IS NOT NULL) AS bad, list(kd ORDER BY pos) FILTER (pos < nl - 1) AS kds FROM k GROUP BY id),
e AS (SELECT *, CASE WHEN nl = 0 THEN ['empty_poem'] ELSE list_concat(list_filter([CASE WHEN nl % 2 = 1 THEN 'incomplete_couplet' END, CASE WHEN ex IS NOT NULL AND nl <> ex THEN 'line_count_mismatch' END, CASE WHEN ex IS NOT NULL AND ex % 2 = 1 THEN 'odd_expected_num_lines' END], lambda x: x IS NOT NULL), coalesce(bad, [])) END AS errs FROM a),
f AS (SELECT *, len(errs) = 0 AS ok, CASE WHEN len(errs) = 0 AND nl >= 2 THEN coalesce(kds, []) ELSE [] END AS kinds, CASE WHEN nl = 0 THEN coalesce(ex, 0) ELSE greatest(nl, coalesce(ex, nl)) END AS slots FROM e),
g AS (SELECT *, CASE WHEN slots = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * gl / slots END AS scr_, CASE WHEN md = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * c / md END AS tcr_, CASE WHEN len(kinds) = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * len(list_filter(kinds, lambda x: x = 'exact')) / len(kinds) END AS ex_, CASE WHEN len(kinds) = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * len(list_filter(kinds, lambda x: x = 'slant')) / len(kinds) END AS sl_ FROM f)
SELECT g.id{keep}, round_even(scr_, 2) AS scr, round_even(tcr_, 2) AS tcr, round_even(ex_, 2) AS exact_rma, round_even(sl_, 2) AS slant_rma, round_even(ex_ + sl_, 2) AS rma, round_even(0.4::DOUBLE * scr_ + 0.3::DOUBLE * tcr_ + 0.3::DOUBLE * (ex_ + sl_), 2) AS overall, (ok AND scr_ = 100 AND tcr_ = 100 AND ex_ + sl_ = 100) AS is_valid, ok AS structure_ok, array_to_string(errs, ',') AS errors, nl AS num_lines, array_to_string(kinds, ',') AS kinds
FROM g{' JOIN b USING (id)' if extra else ''})"""


def flat(df: DataFrame, key: str) -> DataFrame:
    e = lambda f: F.col("ev")[f].alias(f)
    same = ("scr", "tcr", "exact_rma", "slant_rma", "rma", "overall", "is_valid", "structure_ok")
    return df.where("ev IS NOT NULL").select(F.col(key).alias("id"), *[e(f) for f in same], F.array_join("ev.errors", ",").alias("errors"), F.col("ev.num_lines").cast("long").alias("num_lines"), F.array_join("ev.rhyme_kinds", ",").alias("kinds"))


@query(f"SELECT * FROM {eval_sql(POEMS, 'rec_no')}")
def poem_evaluate(spark, sf_dir):
    return flat(ev.evaluate(table(spark, sf_dir, POEMS).select("rec_no", "text")), "rec_no")


@query(f"SELECT * FROM {eval_sql(WEB, 'rec_no', 'CAST(4 AS INT)')}")
def poem_evaluate_expected(spark, sf_dir):
    return flat(ev.evaluate(table(spark, sf_dir, WEB).select("rec_no", "text"), expected=4), "rec_no")


_LINES = f"list_filter(list_transform(regexp_split_to_array(text, {S.q(T.LINE_END)}), lambda x: lower({S.strip('x')})), lambda x: x <> '')"
_WORDS = f"regexp_extract_all(lower(text), {S.q(T.WORD_ANY)})"
_RUN = f"coalesce(list_max(list_transform(range(1, len({_WORDS}) + 1), lambda i: CASE WHEN i >= 4 AND {_WORDS}[i] = {_WORDS}[i - 1] AND {_WORDS}[i] = {_WORDS}[i - 2] AND {_WORDS}[i] = {_WORDS}[i - 3] THEN 4 ELSE 1 END)), 0) >= 4"
_REASONS = f"""SELECT id, split, structure_ok, list_filter([CASE WHEN NOT structure_ok THEN 'structure' END, CASE WHEN tcr < 95 THEN 'tone' END, CASE WHEN rma < 90 THEN 'rhyme' END, CASE WHEN rep THEN 'repeated_line' END, CASE WHEN run THEN 'repeated_token_run' END], lambda x: x IS NOT NULL) AS reasons
FROM {eval_sql(POEMS, 'rec_no', extra='split')} JOIN (SELECT rec_no AS id, len({_LINES}) <> len(list_distinct({_LINES})) AS rep, {_RUN} AS run FROM {POEMS} WHERE text IS NOT NULL) USING (id)"""


def gated(spark, sf_dir) -> DataFrame:
    rows = ev.evaluate(table(spark, sf_dir, POEMS).select("rec_no", "split", "text")).where("ev IS NOT NULL")
    return ev.quality_reasons(rows)


@query(f"SELECT id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS accepted FROM ({_REASONS})")
def quality_gate(spark, sf_dir):
    return gated(spark, sf_dir).select(F.col("rec_no").alias("id"), F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("accepted"))


@query(f"SELECT coalesce(split, '?') AS split, reason, count(*) AS n FROM (SELECT split, unnest(CASE WHEN len(reasons) = 0 THEN ['accepted'] ELSE reasons END) AS reason FROM ({_REASONS})) GROUP BY ALL")
def quality_reasons(spark, sf_dir):
    """Accepted records and reasons against the others, by split as stored; a record counts for each reason."""
    each = F.when(F.size("reasons") == 0, F.array(F.lit("accepted"))).otherwise(F.col("reasons"))
    return gated(spark, sf_dir).select(F.coalesce("split", F.lit("?")).alias("split"), F.explode(each).alias("reason")).groupBy("split", "reason").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS input_rows, count(*) FILTER (len(reasons) = 0) AS accepted_rows, round_even(count(*) FILTER (len(reasons) = 0) / count(*)::DOUBLE, 6) AS acceptance_rate FROM ({_REASONS})")
def quality_stats(spark, sf_dir):
    good = F.sum((F.size("reasons") == 0).cast("long"))
    return gated(spark, sf_dir).agg(F.count("*").alias("input_rows"), good.alias("accepted_rows"), F.bround(good.cast("double") / F.count("*"), 6).alias("acceptance_rate"))


_FLAT = f"SELECT rec_no AS id, i - 1 AS i, s[i] AS syllable, s FROM (SELECT rec_no, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT rec_no, flatten(list_transform(string_split(nfc_normalize(text), chr(10)), lambda l: {S.tokens('l')})) AS s FROM {WEB} WHERE text IS NOT NULL))"


@query(
    f"""SELECT id, i, syllable, {S.tone('syllable')} AS tone, {S.rhyme('syllable')} AS rhyme, CASE WHEN i % 14 < 6 THEN 'luc' ELSE 'bat' END AS line_type, CASE WHEN i % 14 < 6 THEN i % 14 + 1 ELSE i % 14 - 5 END AS place,
CASE WHEN i % 14 IN (1, 5, 7, 11) THEN 'B' WHEN i % 14 IN (3, 9) THEN 'T' WHEN i % 14 = 13 THEN CASE {S.tone('b2')} WHEN 'ngang' THEN 'HUYEN' WHEN 'huyền' THEN 'NGANG' ELSE 'B' END END AS required_tone,
CASE WHEN i % 14 IN (5, 11) AND i >= 6 THEN {S.rhyme('b6')} END AS required_rhyme
FROM (SELECT id, i, syllable, lag(syllable, 2) OVER (PARTITION BY id ORDER BY i) AS b2, lag(syllable, 6) OVER (PARTITION BY id ORDER BY i) AS b6 FROM ({_FLAT}))"""
)
def prosody_trace(spark, sf_dir):
    rows = ev.prosody_trace(table(spark, sf_dir, WEB), "rec_no")
    return rows.withColumn("i", F.col("i").cast("long")).withColumn("place", F.col("place").cast("long"))


_ANCHOR = f"(SELECT id, max(CASE WHEN pos = 0 THEN tk[6] END) AS a1, max(CASE WHEN pos = 1 THEN tk[6] END) AS a2, max(CASE WHEN pos = 1 THEN tk[8] END) AS a3, max(CASE WHEN pos = 2 THEN tk[6] END) AS a4, max(CASE WHEN pos = 3 THEN tk[6] END) AS a5 FROM ({S.line_table(WEB, 'rec_no')}) GROUP BY id)"
_NAMES = T.SCAFFOLD_KEYS
_A = ["a1", "a2", "a3", "a4", "a5"]
_ONE = " ".join(f"WHEN {a} IS NOT NULL AND len({S.tokens(a)}) <> 1 THEN {S.q(n + '_must_be_one_syllable')}" for a, n in zip(_A, _NAMES))
_FLATTONE = "list_filter([" + ", ".join(f"CASE WHEN NOT {S.bang(a)} THEN {S.q(n)} END" for a, n in zip(_A, _NAMES)) + "], lambda x: x IS NOT NULL)"
_APART = "list_filter([" + ", ".join(f"CASE WHEN {S.kind(S.rhyme(_A[i]), S.rhyme(_A[k]))} IS NULL THEN {S.q(_NAMES[i] + ':' + _NAMES[k])} END" for i, k in ((0, 1), (2, 3), (3, 4))) + "], lambda x: x IS NOT NULL)"


@query(
    f"""SELECT id, reason, reason IS NULL AS valid FROM (SELECT id, CASE WHEN a1 IS NULL OR a2 IS NULL OR a3 IS NULL OR a4 IS NULL OR a5 IS NULL THEN 'invalid_scaffold_schema' {_ONE}
WHEN len({_FLATTONE}) > 0 THEN 'anchor_not_bang:' || array_to_string({_FLATTONE}, ',')
WHEN ({S.tone('a2')} = 'huyền' AND {S.tone('a3')} <> 'ngang') OR ({S.tone('a2')} = 'ngang' AND {S.tone('a3')} <> 'huyền') THEN 'line_2_bang_pair_must_alternate'
WHEN len({_APART}) > 0 THEN 'rhyme_mismatch:' || array_to_string({_APART}, ',') END AS reason FROM {_ANCHOR})"""
)
def scaffold_check(spark, sf_dir):
    """The rhyme anchors of every window, held against the rules for a proposed scaffold."""
    tk = tx.line_tokens(tx.nfc(F.col("text")))
    rows = table(spark, sf_dir, WEB).select(F.col("rec_no").alias("id"), tk.alias("l")).where(F.size("l") > 0)
    at = lambda line, k: F.get(F.get("l", F.lit(line)), F.lit(k - 1))
    rows = rows.select("id", at(0, 6).alias("a1"), at(1, 6).alias("a2"), at(1, 8).alias("a3"), at(2, 6).alias("a4"), at(3, 6).alias("a5"))
    found = ev.resolve_scaffold(rows, _A)
    return found.select("id", F.col("scaffold_reason").alias("reason"), (F.col("scaffold_source") == "validated").alias("valid"))


# Keywords of a record for the guard and coverage queries: fixed phrases, one of them by the key.
KEYWORDS = [["mai vàng", "sum vầy"], ["con cháu", "lộc xuân", "bình an"], ["bánh tét", "quê nhà"], ["vui khỏe", "chén trà"]]
INTENTS = ["chúc ông bà sum vầy", "chúc con cháu học giỏi", "mừng thầy cô năm mới", "chúc mọi nhà"]


def _choose(values) -> F.Column:
    return F.get(F.array(*values), F.pmod(F.col("rec_no"), F.lit(4)).cast("int"))


def wished(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, WEB).select("rec_no", "text").where("text IS NOT NULL")
    keys = _choose([F.array(*map(F.lit, k)) for k in KEYWORDS])
    return rows.withColumn("keywords", keys).withColumn("intent", _choose([F.lit(i) for i in INTENTS]))


_KEYS = "[" + ", ".join(S.array(k) for k in KEYWORDS) + "][rec_no % 4 + 1]"
_INTENT = S.array(INTENTS) + "[rec_no % 4 + 1]"
_G = S.words("nfc_normalize(text)")
_CUT = f"flatten(list_transform(list_transform({_KEYS}, lambda k: {S.words('k')}), lambda k: list_filter(list_transform(range(1, len(g) - len(k) + 2), lambda i: CASE WHEN len(k) >= 2 AND g[i : i + len(k) - 2] = k[: len(k) - 1] AND g[i + len(k) - 1] <> k[-1] AND starts_with(k[-1], g[i + len(k) - 1]) THEN array_to_string(g[i : i + len(k) - 1], ' ') END), lambda x: x IS NOT NULL)))"
_ORPHAN = f"list_filter(g, lambda t: list_contains({S.array(T.ORPHAN_VOWELS)}, t))"
_ASSESSED = f"SELECT rec_no, text, {_ORPHAN} AS orphans, {_CUT} AS cut FROM (SELECT rec_no, text, {_G} AS g FROM {WEB} WHERE text IS NOT NULL)"


@query(f"SELECT rec_no, array_to_string(orphans, ',') AS orphans, array_to_string(cut, ',') AS truncated, (len(orphans) > 0 OR len(cut) > 0) AS hard_fail FROM ({_ASSESSED})")
def lexical_audit(spark, sf_dir):
    rows = lx.assess(wished(spark, sf_dir), "text", "keywords")
    return rows.select("rec_no", F.array_join("orphans", ",").alias("orphans"), F.array_join("truncated", ",").alias("truncated"), "hard_fail")


@query(f"SELECT issue, count(*) AS n, count(DISTINCT rec_no) AS records FROM (SELECT rec_no, unnest(list_concat(list_transform(orphans, lambda x: 'orphan_vowel'), list_transform(cut, lambda x: 'truncated_keyword'))) AS issue FROM ({_ASSESSED})) GROUP BY 1")
def lexical_issue_counts(spark, sf_dir):
    rows = lx.assess(wished(spark, sf_dir), "text", "keywords")
    issues = F.concat(F.transform("orphans", lambda x: F.lit("orphan_vowel")), F.transform("truncated", lambda x: F.lit("truncated_keyword")))
    return rows.select("rec_no", F.explode(issues).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"), F.countDistinct("rec_no").alias("records"))


def _has(hay: str, phrase: str) -> str:
    return f"contains(' ' || array_to_string({hay}, ' ') || ' ', {S.q(' ' + phrase + ' ')})"


_W, _I = S.tokens("nfc_normalize(text)"), S.tokens("nfc_normalize(intent)")
_RCP = ", ".join(
    f"CASE WHEN {_has('iw', name)}" + (f" AND ({_has('iw', 'chúc con cháu')} OR {_has('iw', 'chúc cho con cháu')})" if name == "con cháu" else "") + f" THEN {S.q(name)} END" for name in T.RECIPIENTS
)
_MISS = ", ".join(f"CASE WHEN list_contains(rcp, {S.q(name)}) AND NOT ({' OR '.join(_has('w', a) for a in al)}) THEN {S.q(name)} END" for name, al in T.RECIPIENTS.items())
_LOOSE = ", ".join(f"CASE WHEN {' OR '.join(_has('w', a) for a in al)} THEN {S.q(name)} END" for name, al in T.KEYWORD_ALIASES.items())
_NN = ", lambda x: x IS NOT NULL)"
_COVER = f"""SELECT rec_no, ex, se, mi, list_filter([CASE WHEN len(miss) > 0 THEN 'missing_recipient' END, CASE WHEN ex < 1 THEN 'no_exact_keyword' END, CASE WHEN se < mi THEN 'insufficient_semantic_keywords' END]{_NN} AS reasons, rcp FROM (
SELECT rec_no, rcp, list_filter([{_MISS}]{_NN} AS miss, len(list_filter(ks, lambda k: contains(' ' || array_to_string(w, ' ') || ' ', ' ' || k || ' '))) AS ex, len(list_filter(ks, lambda k: contains(' ' || array_to_string(w, ' ') || ' ', ' ' || k || ' ') OR list_contains(list_filter([{_LOOSE}]{_NN}, k))) AS se, least(2, len(ks)) AS mi
FROM (SELECT *, list_filter([{_RCP}]{_NN} AS rcp FROM (SELECT rec_no, {_W} AS w, {_I} AS iw, list_transform(ks0, lambda k: array_to_string({S.tokens('k')}, ' ')) AS ks FROM (SELECT rec_no, text, {_INTENT} AS intent, {_KEYS} AS ks0 FROM {WEB} WHERE text IS NOT NULL))))"""


@query(f"SELECT rec_no, ex AS exact_count, se AS semantic_count, mi AS minimum, array_to_string(reasons, ',') AS reasons, array_to_string(rcp, ',') AS recipients FROM ({_COVER})")
def coverage(spark, sf_dir):
    rows = lx.coverage(wished(spark, sf_dir), "text", "intent", "keywords")
    c = lambda f: F.col("coverage")[f]
    long = lambda f, n: c(f).cast("long").alias(n)
    return rows.select("rec_no", long("exact_count", "exact_count"), long("semantic_count", "semantic_count"), long("minimum", "minimum"), F.array_join(c("reasons"), ",").alias("reasons"), F.array_join(c("recipients"), ",").alias("recipients"))


@query(
    f"SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN len(r) = 0 THEN ['accepted'] ELSE r END) AS reason FROM (SELECT list_concat(c.reasons, list_filter([CASE WHEN len(a.orphans) > 0 OR len(a.cut) > 0 THEN 'lexical_hard_fail' END, CASE WHEN NOT (e.scr = 100 AND e.tcr = 100 AND e.rma = 100) THEN 'form_below_gate' END]{_NN}) AS r FROM ({_COVER}) c JOIN ({_ASSESSED}) a USING (rec_no) JOIN {eval_sql(WEB, 'rec_no', 'CAST(4 AS INT)')} e ON e.id = c.rec_no)) GROUP BY 1"
)
def acceptance(spark, sf_dir):
    """What stands against accepting each window: coverage, lexical errors, form."""
    rows = ev.evaluate(wished(spark, sf_dir), expected=4)
    rows = lx.acceptance(lx.coverage(lx.assess(rows, "text", "keywords"), "text", "intent", "keywords"))
    each = F.when(F.col("accepted"), F.array(F.lit("accepted"))).otherwise(F.col("accept_reasons"))
    return rows.select(F.explode(each).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def _line_words(name: str, key: str, extra: str = "") -> str:
    keep = f", {extra}" if extra else ""
    return f"SELECT id, line_no{keep}, {S.words('line')} AS words FROM (SELECT {key} AS id{keep}, unnest(regexp_split_to_array(text, {S.q(T.LINE_END)})) AS line, generate_subscripts(regexp_split_to_array(text, {S.q(T.LINE_END)}), 1) AS line_no FROM {name} WHERE text IS NOT NULL)"


def _bigrams(name: str, key: str) -> str:
    return f"SELECT id, line_no, i, words[i] AS l, words[i + 1] AS r FROM (SELECT id, line_no, words, unnest(range(1, len(words))) AS i FROM ({_line_words(name, key)}))"


_UNI = f"SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM ({_line_words(POEMS, 'rec_no')})) GROUP BY 1"
_BI = f"SELECT l, r, count(*) AS n FROM ({_bigrams(POEMS, 'rec_no')}) GROUP BY ALL"
_SCORED = f"SELECT s.id, s.line_no, s.i, s.l, s.r, coalesce(b.n, 0) AS n, ln((coalesce(b.n, 0) + 0.1::DOUBLE) / (coalesce(u.n, 0) + 0.1::DOUBLE * (SELECT greatest(1, count(*)) FROM ({_UNI})))) AS lp FROM ({_bigrams(WEB, 'rec_no')}) s LEFT JOIN ({_BI}) b ON b.l = s.l AND b.r = s.r LEFT JOIN ({_UNI}) u ON u.word = s.l"


def scored(spark, sf_dir) -> DataFrame:
    uni, bi = co.counts(co.line_words(table(spark, sf_dir, POEMS), "rec_no"))
    return co.scored_bigrams(co.line_words(table(spark, sf_dir, WEB), "rec_no"), uni, bi)


@query(_UNI)
def unigrams(spark, sf_dir):
    return co.counts(co.line_words(table(spark, sf_dir, POEMS), "rec_no"))[0]


@query(f'SELECT l AS "left", r AS "right", n FROM ({_BI})')
def bigrams(spark, sf_dir):
    return co.counts(co.line_words(table(spark, sf_dir, POEMS), "rec_no"))[1]


_PER_POEM = f"SELECT id, count(*) AS pairs, avg(lp) AS raw, avg((n = 0)::INT::DOUBLE) AS unseen, avg((n <= 1)::INT::DOUBLE) AS rare FROM ({_SCORED}) GROUP BY id"


@query(f"SELECT id, pairs, round_even(raw, 3) AS mean_lp, round_even(unseen, 4) AS unseen, round_even(rare, 4) AS rare, round_even(greatest(0, least(1, (raw + 12) / 8)), 3) AS score FROM ({_PER_POEM})")
def collocation_score(spark, sf_dir):
    s = co.poem_scores(scored(spark, sf_dir))
    return s.select("id", "pairs", F.bround("raw", 3).alias("mean_lp"), "unseen", "rare", F.bround(co.bounded(F.col("raw")), 3).alias("score"))


@query(f'SELECT id, rank, l AS "left", r AS "right", n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n, round(lp, 9), line_no, i) AS rank FROM ({_SCORED})) WHERE rank <= 5')
def lowest_bigrams(spark, sf_dir):
    return co.lowest(scored(spark, sf_dir)).select("id", F.col("rank").cast("long").alias("rank"), "left", "right", "n")


@query(f"SELECT coalesce(domain, '?') AS domain, count(*) AS n, round_even(avg(m), 2) AS mean_lp, round_even(avg(u), 3) AS unseen, round_even(avg(r), 3) AS rare FROM (SELECT id, round_even(raw, 4) AS m, round_even(unseen, 4) AS u, round_even(rare, 4) AS r FROM ({_PER_POEM})) JOIN {WEB} ON rec_no = id GROUP BY 1")
def collocation_report(spark, sf_dir):
    """Means of the poems' rounded figures by domain."""
    s = co.poem_scores(scored(spark, sf_dir)).join(table(spark, sf_dir, WEB).select(F.col("rec_no").alias("id"), F.coalesce("domain", F.lit("?")).alias("domain")), "id")
    return s.groupBy("domain").agg(F.count("*").alias("n"), F.bround(F.avg("mean_lp"), 2).alias("mean_lp"), F.bround(F.avg("unseen"), 3).alias("unseen"), F.bround(F.avg("rare"), 3).alias("rare"))
