"""Queries on ranking, duplicates, splits and samples, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.functions import tables as T
from versemill.functions import text as tx
from versemill.operators import collocation as co
from versemill.operators import dedup as dd
from versemill.operators import rank as rk
from versemill.operators import sample as sm
from versemill.plans import sql as S
from versemill.plans.lineage import cut
from versemill.plans.poem_queries import _ASSESSED, _PER_POEM, DOCS, KEYWORDS, POEMS, WEB, eval_sql, scored
from versemill.plans.session import table

QUERIES, SQL = {}, {}
MATERIAL = "tet4_source_material_corpus_v1"
# A list of worn phrases for the queries; the operator takes any list.
CLICHES = ["bánh chưng", "bánh tét", "mùa xuân", "quê nhà", "hoa mai", "năm mới", "mai vàng", "sum vầy"]
# The sets of weights that are compared, as (evaluator, diversity, cliche, keyword, length).
WEIGHTS = [
    (0.35, 0.20, 0.15, 0.20, 0.10),
    (0.50, 0.15, 0.15, 0.12, 0.08),
    (0.55, 0.14, 0.13, 0.10, 0.08),
    (0.60, 0.13, 0.12, 0.10, 0.05),
    (0.65, 0.12, 0.11, 0.08, 0.04),
    (0.70, 0.10, 0.10, 0.06, 0.04),
    (0.75, 0.05, 0.12, 0.05, 0.03),
    (0.75, 0.08, 0.10, 0.05, 0.02),
    (0.78, 0.06, 0.10, 0.04, 0.02),
    (0.80, 0.05, 0.10, 0.03, 0.02),
    (0.80, 0.04, 0.10, 0.04, 0.02),
    (0.85, 0.03, 0.07, 0.03, 0.02),
    (0.90, 0.04, 0.02, 0.02, 0.02),
]
WEIGHT_SETS = {f"set {k:02d}": dict(zip(("evaluator", "diversity", "cliche", "keyword", "length"), w)) for k, w in enumerate(WEIGHTS, 1)}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def pools(spark, sf_dir) -> DataFrame:
    """Pools of eight neighbouring windows as candidates for one prompt of four lines."""
    rows = table(spark, sf_dir, WEB).select("rec_no", "text").where("text IS NOT NULL")
    pool = F.floor((F.col("rec_no") - 1) / 8)
    rows = rows.withColumn("pool", pool).withColumn("idx", (F.col("rec_no") - 1) % 8)
    keys = F.get(F.array(*[F.array(*map(F.lit, k)) for k in KEYWORDS]), F.pmod(F.col("rec_no"), F.lit(4)).cast("int"))
    rows = rk.components(rows.withColumn("keywords", keys), "text", "keywords", F.lit(4), CLICHES)
    return rk.guarded(rows, "text", "keywords").withColumn("score", rk.total(F.col("parts")))


_S = f"flatten(list_transform(string_split(nfc_normalize(text), chr(10)), lambda l: {S.tokens('l')}))"
_KEYED = "[" + ", ".join(S.array(k) for k in KEYWORDS) + "][rec_no % 4 + 1]"
_HITS = " + ".join(f"contains(lower(text), {S.q(c)})::INT" for c in CLICHES)
_PARTS = f"""SELECT e.id, (e.id - 1) // 8 AS pool, (e.id - 1) % 8 AS idx, e.overall, e.scr, e.tcr, e.rma, e.exact_rma, e.slant_rma, e.is_valid, greatest(0.0, least(1.0, e.overall / 100.0)) AS p1, CASE WHEN len(s) < 2 THEN 0.0 ELSE len(list_distinct(list_transform(range(1, len(s)), lambda i: s[i] || ' ' || s[i + 1])))::DOUBLE / (len(s) - 1) END AS p2, -least(1.0, 0.25::DOUBLE * ({_HITS})) AS p3,
len(list_filter(list_transform(ks, lambda k: {S.tokens('k')}), lambda k: len(list_filter(k, lambda w: NOT list_contains(s, w))) = 0))::DOUBLE / len(ks) AS p4, greatest(0.0, 1.0 - abs(e.num_lines - 4)) AS p5, hf
FROM {eval_sql(WEB, 'rec_no', 'CAST(4 AS INT)')} e JOIN (SELECT rec_no, text, {_S} AS s, {_KEYED} AS ks FROM {WEB} WHERE text IS NOT NULL) d ON d.rec_no = e.id JOIN (SELECT rec_no AS r2, (len(orphans) > 0 OR len(cut) > 0) AS hf FROM ({_ASSESSED})) ON r2 = e.id"""


def _total(w) -> str:
    return "round_even(" + " + ".join(["0.0::DOUBLE"] + [f"{float(w[n])}::DOUBLE * {p}" for n, p in (("evaluator", "p1"), ("diversity", "p2"), ("cliche", "p3"), ("keyword", "p4"), ("length", "p5"))]) + ", 4)"


_RANKED = f"SELECT *, row_number() OVER (PARTITION BY pool ORDER BY hf, score DESC, idx) AS place, row_number() OVER (PARTITION BY pool ORDER BY score DESC, idx) AS plain FROM (SELECT *, {_total(T.RANK_WEIGHTS)} AS score FROM ({_PARTS}))"


@query(f"SELECT id, pool, idx, round_even(p2, 6) AS diversity, p3 AS cliche, round_even(p4, 6) AS keyword, p5 AS length, score, place FROM ({_RANKED})")
def rerank(spark, sf_dir):
    p = lambda n: F.col("parts")[n]
    rows = rk.rerank(pools(spark, sf_dir), guard="hard_fail")
    return rows.select(F.col("rec_no").alias("id"), "pool", "idx", F.bround(p("diversity"), 6).alias("diversity"), p("cliche").alias("cliche"), F.bround(p("keyword"), 6).alias("keyword"), p("length").alias("length"), "score", F.col("place").cast("long").alias("place"))


@query(f"SELECT pool, id, overall FROM ({_RANKED}) WHERE place = 1")
def rerank_top1(spark, sf_dir):
    return rk.rerank(pools(spark, sf_dir), guard="hard_fail").where("place = 1").select("pool", F.col("rec_no").alias("id"), F.col("ev.overall").alias("overall"))


_SETS = ", ".join(f"({S.q(n)}, {', '.join(f'{v}::DOUBLE' for v in w.values())})" for n, w in WEIGHT_SETS.items())
_CORR = lambda x, y: f"coalesce(CASE WHEN stddev_pop({x}) * stddev_pop({y}) = 0 THEN 0 ELSE covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END, 0)"


@query(
    f"""WITH parts AS MATERIALIZED ({_PARTS}), swept AS (SELECT v.weights, pool, idx, overall, round_even(0.0::DOUBLE + w1 * p1 + w2 * p2 + w3 * p3 + w4 * p4 + w5 * p5, 4) AS score FROM parts, (VALUES {_SETS}) v(weights, w1, w2, w3, w4, w5)),
placed AS (SELECT *, max(overall) OVER (PARTITION BY weights, pool) AS most, row_number() OVER (PARTITION BY weights, pool ORDER BY score DESC, idx) AS place FROM swept), per AS (SELECT weights, pool, {_CORR('score', 'overall')} AS corr FROM swept GROUP BY ALL)
SELECT weights, count(*) AS pools, round_even(avg((abs(overall - most) < 1e-9)::INT::DOUBLE), 4) AS top1_agree, round_even(avg(overall), 3) AS mean_overall, round(avg(corr), 2) AS mean_correlation FROM placed JOIN per USING (weights, pool) WHERE place = 1 GROUP BY weights"""
)
def weight_sweep(spark, sf_dir):
    """All thirteen sets of weights over all pools."""
    return rk.sweep(pools(spark, sf_dir), WEIGHT_SETS)


@query(
    f"""WITH ranked AS MATERIALIZED ({_RANKED}), per AS (SELECT pool, max(overall) AS most, {_CORR('score', 'overall')} AS corr FROM ranked GROUP BY pool), best AS (SELECT * FROM ranked JOIN per USING (pool) WHERE plain = 1)
SELECT count(*) AS n, round_even(avg(scr), 1) AS scr, round_even(avg(tcr), 1) AS tcr, round_even(avg(exact_rma), 1) AS exact_rma, round_even(avg(slant_rma), 1) AS slant_rma, round_even(avg(rma), 1) AS rma, round_even(avg(overall), 1) AS overall, count(*) FILTER (is_valid) AS valid_n, count(*) FILTER (NOT is_valid) AS rejected_n, round_even(avg((abs(overall - most) < 1e-9)::INT::DOUBLE), 3) AS top1_agree, round(avg(corr), 3) AS avg_corr FROM best"""
)
def benchmark_totals(spark, sf_dir):
    """What a benchmark reports of the best candidates of all pools."""
    return rk.benchmark_totals(rk.rerank(pools(spark, sf_dir)))


@query(f"SELECT pool, count(*) AS n, round_even(coalesce(CASE WHEN stddev_pop(score) * stddev_pop(overall) = 0 THEN 0 ELSE covar_pop(score, overall) / (stddev_pop(score) * stddev_pop(overall)) END, 0), 4) AS correlation FROM ({_RANKED}) GROUP BY pool HAVING count(*) >= 2")
def score_correlation(spark, sf_dir):
    """How the ranking score follows the evaluator in each pool."""
    rows = pools(spark, sf_dir).select("pool", "score", F.col("ev.overall").alias("overall"))
    return rows.groupBy("pool").agg(F.count("*").alias("n"), F.bround(rk.pearson(F.col("score"), F.col("overall")), 4).alias("correlation")).where("n >= 2")


@query(f"SELECT variant, count(*) AS n, count(*) FILTER (is_valid) AS valid_n, round_even(avg(scr), 1) AS scr, round_even(avg(tcr), 1) AS tcr, round_even(avg(rma), 1) AS rma, round_even(avg(overall), 1) AS overall FROM (SELECT 'first' AS variant, * FROM ({_RANKED}) WHERE idx = 0 UNION ALL SELECT 'best' AS variant, * FROM ({_RANKED}) WHERE plain = 1) GROUP BY variant")
def ablation(spark, sf_dir):
    """First candidates against the best-ranked ones."""
    rows = rk.rerank(pools(spark, sf_dir))
    kinds = F.array_compact(F.array(F.when(F.col("idx") == 0, "first"), F.when(F.col("place") == 1, "best")))
    rows = rows.select(F.explode(kinds).alias("variant"), "ev")
    mean = lambda f: F.bround(F.avg(F.col("ev")[f]), 1).alias(f)
    return rows.groupBy("variant").agg(F.count("*").alias("n"), F.sum(F.col("ev.is_valid").cast("long")).alias("valid_n"), mean("scr"), mean("tcr"), mean("rma"), mean("overall"))


@query(f"SELECT count(*) AS pools, count(*) FILTER (b.id <> a.id) AS changes, round_even(avg(b.overall), 3) AS before_overall, round_even(avg(a.overall), 3) AS after_overall, round_even(avg(b.rma), 3) AS before_rma, round_even(avg(a.rma), 3) AS after_rma FROM (SELECT * FROM ({_RANKED}) WHERE plain = 1) b JOIN (SELECT * FROM ({_RANKED}) WHERE place = 1) a USING (pool)")
def guard_before_after(spark, sf_dir):
    """What the lexical guard changes: scores are worked out once, only the order differs."""
    rows = rk.rerank(rk.rerank(pools(spark, sf_dir)).withColumnRenamed("place", "plain"), guard="hard_fail")
    at = lambda c, f: F.max(F.when(F.col(c) == 1, f))
    one = rows.groupBy("pool").agg(at("plain", F.col("rec_no")).alias("b"), at("place", F.col("rec_no")).alias("a"), at("plain", F.col("ev.overall")).alias("bo"), at("place", F.col("ev.overall")).alias("ao"), at("plain", F.col("ev.rma")).alias("br"), at("place", F.col("ev.rma")).alias("ar"))
    three = lambda c, n: F.bround(F.avg(c), 3).alias(n)
    return one.agg(F.count("*").alias("pools"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("changes"), three("bo", "before_overall"), three("ao", "after_overall"), three("br", "before_rma"), three("ar", "after_rma"))


_BLENDED = f"SELECT pool, idx, raw, score, row_number() OVER (PARTITION BY pool ORDER BY round(raw, 9) NULLS FIRST, idx) - 1 AS r, count(*) OVER (PARTITION BY pool) AS c FROM (SELECT *, min(hf::INT) OVER (PARTITION BY pool) AS allbad FROM ({_RANKED}) LEFT JOIN (SELECT id, raw FROM ({_PER_POEM})) USING (id)) WHERE allbad = 1 OR NOT hf"


@query(f"SELECT pool, idx FROM (SELECT pool, idx, row_number() OVER (PARTITION BY pool ORDER BY round(score + 0.05::DOUBLE * (r / greatest(1, c - 1)::DOUBLE), 9) DESC, idx) AS rn FROM ({_BLENDED})) WHERE rn = 1")
def rank_blend(spark, sf_dir):
    raw = co.poem_scores(scored(spark, sf_dir)).select(F.col("id").alias("rec_no"), F.round("raw", 9).alias("raw"))
    return rk.blend(pools(spark, sf_dir).join(raw, "rec_no", "left"), 0.05)


_WITH_COLLOCATION = f"round_even(score_ + 0.05::DOUBLE * coalesce(greatest(0, least(1, (raw + 12) / 8)), 0), 4)"


@query(f"SELECT id, abs(total - (score + 0.05::DOUBLE * coalesce(greatest(0, least(1, (raw + 12) / 8)), 0))) < 0.0002 AS adds_up, raw IS NOT NULL AS scored FROM (SELECT r.id, r.score, p.raw, {_WITH_COLLOCATION} AS total FROM (SELECT *, {_total(T.RANK_WEIGHTS)} AS score_ FROM ({_RANKED})) r LEFT JOIN ({_PER_POEM}) p USING (id))")
def rerank_collocation(spark, sf_dir):
    """The ranking score with the collocation score as its sixth part: it adds its weight and nothing else."""
    raw = co.poem_scores(scored(spark, sf_dir)).select(F.col("id").alias("rec_no"), "raw")
    part = co.bounded(F.col("raw"))
    rows = pools(spark, sf_dir).join(raw, "rec_no", "left")
    whole = rk.total(F.col("parts"), {**T.RANK_WEIGHTS, "collocation": 0.05}, {"collocation": part})
    return rows.select(F.col("rec_no").alias("id"), (F.abs(whole - (F.col("score") + 0.05 * part)) < 0.0002).alias("adds_up"), F.col("raw").isNotNull().alias("scored"))


_CP = f"SELECT r.pool, r.idx, r.overall, round_even(p.raw, 4) AS lp FROM ({_RANKED}) r JOIN ({_PER_POEM}) p USING (id)"


@query(f"SELECT pool, high, low, gap FROM (SELECT a.pool, a.idx AS high, b.idx AS low, round_even(a.lp - b.lp, 4) AS gap, row_number() OVER (PARTITION BY a.pool ORDER BY round_even(a.lp - b.lp, 4) DESC, a.idx, b.idx) AS rn FROM ({_CP}) a JOIN ({_CP}) b ON a.pool = b.pool AND abs(a.overall - b.overall) <= 10 AND a.lp > b.lp) WHERE rn = 1")
def collocation_pair(spark, sf_dir):
    """In each pool the pair of like scores whose wording differs most in expectedness."""
    lp = co.poem_scores(scored(spark, sf_dir)).select(F.col("id").alias("rec_no"), "mean_lp")
    return co.best_pairs(pools(spark, sf_dir).select("rec_no", "pool", "idx", F.col("ev.overall").alias("overall")).join(lp, "rec_no"))


@query(f"SELECT pool, high, low, gap, place FROM (SELECT *, row_number() OVER (ORDER BY gap DESC, pool) AS place FROM (SELECT a.pool, a.idx AS high, b.idx AS low, round_even(a.lp - b.lp, 4) AS gap, row_number() OVER (PARTITION BY a.pool ORDER BY round_even(a.lp - b.lp, 4) DESC, a.idx, b.idx) AS rn FROM ({_CP}) a JOIN ({_CP}) b ON a.pool = b.pool AND abs(a.overall - b.overall) <= 10 AND a.lp > b.lp) WHERE rn = 1) WHERE place <= 20")
def clearest_gaps(spark, sf_dir):
    """The twenty pools whose pairs differ most."""
    return co.clearest(collocation_pair(spark, sf_dir), 20)


_STAGED = f"(SELECT rec_no, coalesce(array_to_string(list_filter(list_transform(regexp_split_to_array(nfc_normalize(coalesce(text, '')), '\\r\\n|\\r|\\n'), lambda x: {S.squeeze('x')}), lambda x: x <> ''), chr(10)), '') AS st FROM {WEB})"


@query(f"SELECT min(rec_no) AS rec_no, count(*) AS copies FROM {_STAGED} GROUP BY sha256(st)")
def exact_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, WEB).select("rec_no", tx.staged(F.col("text")).alias("st"))
    return dd.keep_first(rows, F.col("st"), "rec_no").select("rec_no", "copies")


_TOK = f"SELECT doc_id AS id, unnest(CASE WHEN len(regexp_extract_all(lower(text), {S.q(T.WORD_ANY)})) = 0 THEN [NULL] ELSE list_distinct(regexp_extract_all(lower(text), {S.q(T.WORD_ANY)})) END) AS w FROM {DOCS} WHERE text IS NOT NULL"
_HASHED = f"SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h, ('0x' || substr(md5(w), 9, 8))::BIGINT AS l FROM ({_TOK})"
_BITS = lambda p: " + ".join(f"(CASE WHEN coalesce(sum(CASE WHEN {p} IS NULL THEN 0 WHEN ({p} >> {k}) & 1 = 1 THEN 1 ELSE -1 END), 0) >= 0 THEN {1 << k} ELSE 0 END)::BIGINT" for k in range(32))
_SIM = f"SELECT id, {_BITS('h')} AS hi, {_BITS('l')} AS lo FROM ({_HASHED}) GROUP BY id"


@query(_SIM)
def simhash(spark, sf_dir):
    return dd.simhash(table(spark, sf_dir, DOCS), "doc_id")


_REPS = f"SELECT hi, lo, min(id) AS rep FROM ({_SIM}) GROUP BY ALL"
_NEAR = f"SELECT a.rep AS a, b.rep AS b, bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS distance FROM ({_REPS}) a JOIN ({_REPS}) b ON a.rep < b.rep AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3"


@query(f"SELECT a, b, CAST(distance AS INT) AS distance FROM ({_NEAR})")
def near_dup_pairs(spark, sf_dir):
    """Classes of equal hashes, paired within three bits; the SQL holds all against all."""
    return dd.near_pairs(cut(dd.simhash(table(spark, sf_dir, DOCS), "doc_id"), "simhash"))[1]


@query(
    f"""WITH RECURSIVE s AS ({_SIM}), r AS (SELECT hi, lo, min(id) AS rep FROM s GROUP BY ALL), n AS (SELECT a.rep AS a, b.rep AS b FROM r a JOIN r b ON a.rep <> b.rep AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3),
reach AS (SELECT rep AS node, rep AS of FROM r UNION SELECT n.b, reach.of FROM reach JOIN n ON n.a = reach.node)
SELECT s.id, 'cluster-' || substr(sha256(CAST(min(reach.of) AS VARCHAR)), 1, 16) AS cluster FROM s JOIN r USING (hi, lo) JOIN reach ON reach.node = r.rep GROUP BY s.id"""
)
def dup_clusters(spark, sf_dir):
    members, pairs = dd.near_pairs(cut(dd.simhash(table(spark, sf_dir, DOCS), "doc_id"), "simhash"))
    return dd.clusters(members, pairs)


_UNIQUE = "(SELECT min(doc_id) AS doc_id, st AS text FROM (SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(regexp_split_to_array(nfc_normalize(coalesce(text, '')), '\\r\\n|\\r|\\n'), lambda x: " + S.squeeze("x") + "), lambda x: x <> ''), chr(10)), '') AS st FROM documents) WHERE st <> '' GROUP BY st)"


@query(
    f"""WITH RECURSIVE u AS MATERIALIZED {_UNIQUE}, s AS MATERIALIZED ({_SIM.replace(f'FROM {DOCS} ', 'FROM u ')}), r AS (SELECT hi, lo, min(id) AS rep FROM s GROUP BY ALL), n AS (SELECT a.rep AS a, b.rep AS b FROM r a JOIN r b ON a.rep <> b.rep AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3),
reach AS (SELECT rep AS node, rep AS of FROM r UNION SELECT n.b, reach.of FROM reach JOIN n ON n.a = reach.node), c AS (SELECT s.id, 'cluster-' || substr(sha256(CAST(min(reach.of) AS VARCHAR)), 1, 16) AS cluster FROM s JOIN r USING (hi, lo) JOIN reach ON reach.node = r.rep GROUP BY s.id),
p AS (SELECT cluster, ('0x' || substr(sha256(cluster), 1, 8))::BIGINT / 4294967295.0::DOUBLE AS p FROM c), i AS (SELECT count(*) AS n FROM documents WHERE regexp_matches(coalesce(text, ''), '[^' || {S.q(T.WS[1:-1])} || ']'))
SELECT i.n AS input_rows, i.n - (SELECT count(*) FROM u) AS exact_duplicates_removed, (SELECT count(*) FROM u) AS staging_rows, count(DISTINCT cluster) AS duplicate_clusters, (SELECT count(*) // 2 FROM n) AS near_duplicate_links, count(*) FILTER (p < 0.8) AS train, count(*) FILTER (p >= 0.8 AND p < 0.9) AS dev, count(*) FILTER (p >= 0.9) AS test FROM p, i GROUP BY i.n"""
)
def staging_stats(spark, sf_dir):
    """What the staging of all documents reports of itself."""
    return dd.staging_stats(table(spark, sf_dir, DOCS), "doc_id")


@query(f"SELECT split, count(*) AS n FROM (SELECT CASE WHEN p < 0.8 THEN 'train' WHEN p < 0.9 THEN 'dev' ELSE 'test' END AS split FROM (SELECT ('0x' || substr(sha256(duplicate_cluster), 1, 8))::BIGINT / 4294967295.0::DOUBLE AS p FROM {POEMS} WHERE duplicate_cluster IS NOT NULL)) GROUP BY split")
def hash_split(spark, sf_dir):
    rows = table(spark, sf_dir, POEMS).where("duplicate_cluster IS NOT NULL")
    return rows.groupBy(dd.hash_split(F.col("duplicate_cluster")).alias("split")).agg(F.count("*").alias("n"))


@query(f"SELECT duplicate_cluster AS cluster, count(DISTINCT split) AS splits FROM {POEMS} WHERE duplicate_cluster IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def leak_check(spark, sf_dir):
    return dd.leaks(table(spark, sf_dir, POEMS), "duplicate_cluster", "split")


@query(f"SELECT work_id, count(*) AS n FROM {POEMS} WHERE work_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def repeated_work_ids(spark, sf_dir):
    return dd.repeated_ids(table(spark, sf_dir, POEMS), "work_id")


@query(f"SELECT split, count(*) AS records, CAST(sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), {S.q(T.WS + '+')}), lambda w: w <> ''))) AS BIGINT) AS tokens FROM {POEMS} GROUP BY split")
def split_token_counts(spark, sf_dir):
    return dd.split_counts(table(spark, sf_dir, POEMS), "split")


@query(f"SELECT rec_no, row_number() OVER (ORDER BY sha256(CAST(rec_no AS VARCHAR)), rec_no) AS place FROM {POEMS} QUALIFY place <= 100")
def audit_sample(spark, sf_dir):
    """The hundred lowest digests."""
    return sm.lowest(table(spark, sf_dir, POEMS).select("rec_no"), "rec_no", 100).select("rec_no", F.col("place").cast("long").alias("place"))


_COUNTED = f"SELECT rec_no, split, len(regexp_split_to_array(text, {S.q(T.LINE_END)})) AS n FROM {POEMS} WHERE text IS NOT NULL"


def counted(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, POEMS).where("text IS NOT NULL").select("rec_no", "split", F.size(tx.any_lines(F.col("text"))).alias("n"))


@query(f"SELECT rec_no, split, n, place FROM (SELECT *, row_number() OVER (PARTITION BY split, n ORDER BY sha256(CAST(rec_no AS VARCHAR)), rec_no) AS place FROM ({_COUNTED}) WHERE n IN (4, 6, 8)) WHERE place <= CASE n WHEN 4 THEN 34 ELSE 33 END")
def stratified_sample(spark, sf_dir):
    """A hundred records of each split, spread over three lengths."""
    rows = sm.quotas(counted(spark, sf_dir), "n", sm.even_quotas(100), "rec_no", ["split"])
    return rows.select("rec_no", "split", F.col("n").cast("long").alias("n"), F.col("place").cast("long").alias("place"))


@query(f"SELECT rec_no, n, backfill FROM (SELECT rec_no, n, row_number() OVER (PARTITION BY n ORDER BY rec_no) > 5 AS backfill FROM ({_COUNTED})) ORDER BY backfill, rec_no LIMIT 60")
def stratified_backfill(spark, sf_dir):
    rows = sm.backfilled(counted(spark, sf_dir), "n", 5, 60, "rec_no")
    return rows.select("rec_no", F.col("n").cast("long").alias("n"), "backfill")


@query(f"SELECT split, n, count(*) AS records FROM ({_COUNTED}) GROUP BY ALL")
def line_count_distribution(spark, sf_dir):
    return counted(spark, sf_dir).groupBy("split", F.col("n").cast("long").alias("n")).agg(F.count("*").alias("records"))


@query(f"SELECT rec_no, substr(sha256('7:side:' || rec_no), 1, 1) < '8' AS a_is_left, 'I' || substr(sha256('7:order:' || rec_no), 1, 12) AS item FROM {POEMS}")
def blind_pairs(spark, sf_dir):
    """The key of a blind form: which side shows what; sides and order come from digests."""
    rows = table(spark, sf_dir, POEMS).select("rec_no", "text", "title")
    return sm.blind_pairs(rows, "rec_no", "text", "title", 7)[1].select("rec_no", "a_is_left", "item")


_MT = "lower(" + S.strip("nfc_normalize(text)") + ")"


@query(f"SELECT text_sha256, min(rec_no) OVER m AS first, count(*) OVER m AS n, row_number() OVER (PARTITION BY text_sha256 ORDER BY rec_no) AS place, ref FROM (SELECT sha256({_MT}) AS text_sha256, rec_no, coalesce(source_id, '') || ' ' || coalesce(unit_type, '') || ' ' || coalesce(url, '') AS ref FROM {MATERIAL}) WINDOW m AS (PARTITION BY text_sha256)")
def merge_materials(spark, sf_dir):
    """Rows of one text as one material with the references of all of them, in order."""
    ref = F.concat(F.coalesce("source_id", F.lit("")), F.lit(" "), F.coalesce("unit_type", F.lit("")), F.lit(" "), F.coalesce("url", F.lit("")))
    rows = table(spark, sf_dir, MATERIAL).withColumn("norm", F.lower(tx.strip(tx.nfc(F.col("text")))))
    materials, references = dd.merge_materials(rows, F.col("norm"), "rec_no", ref)
    return materials.join(references, "text_sha256").select("text_sha256", "first", "n", "place", "ref")
