"""The queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from versemill.llm import encode, lookalikes, mix, near_duplicates, spans, split_groups, split_overlap, survivors
from versemill.llm import textform as tf
from versemill.plans import sql as S
from versemill.plans.session import table

WEB, MATERIAL, QUALITY = "tet4_web_staging_v1", "tet4_source_material_corpus_v1", "quality_fsoft_v1"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(table(spark, sf_dir, WEB))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.lookalike_pairs(table(spark, sf_dir, WEB))


def p2_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.unified(table(spark, sf_dir, WEB)).selectExpr("rec AS rec_no", "form AS text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.best_representatives(table(spark, sf_dir, MATERIAL), table(spark, sf_dir, "source_trust"))


def p3_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(table(spark, sf_dir, MATERIAL), table(spark, sf_dir, "source_trust"))


def p3_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.references(table(spark, sf_dir, MATERIAL))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.cross_split_pairs(table(spark, sf_dir, QUALITY))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.overlap_report(table(spark, sf_dir, QUALITY))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_groups.torn_groups(table(spark, sf_dir, QUALITY))


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_groups.assign_splits(table(spark, sf_dir, QUALITY))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_corpus(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.short_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.span_pairs(table(spark, sf_dir, "documents"))


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.passages(table(spark, sf_dir, "documents"))


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_amount(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (p1_found, p2_found, p2_text, p3_found, p3_survivors, p3_refs, p4_found, p4_report, p5_found, p5_splits, p6_ids, p7_found, p7_mix, p7_shares, p8_found, p8_spans, p8_shared)
    return {f.__name__: f for f in every}


def _p3() -> str:
    """The definition itself, with each field's test written out."""
    author = f"regexp_replace(lower(author), '^[\\s()\\[\\]<>\".:'']+|[\\s()\\[\\]<>\":'']+$', '', 'g')"
    author = f"coalesce(regexp_matches({author}, '[\\pL\\pN]') AND {author} NOT IN ({', '.join(S.q(x) for x in survivors.NOBODY)}), false)"
    url = "coalesce(regexp_matches(lower(url), '^\\s*https?://[^\\s/?#]*[a-z0-9]'), false)"
    refs = "coalesce(len(list_filter(source_refs, lambda r: coalesce(trim(r.source_id), '') <> '' OR coalesce(trim(r.url), '') <> '')) > 0, false)"
    rows = f"SELECT rec_no, lower({S.strip('nfc_normalize(text)')}) AS m, {author} AS a, {url} AS u, {refs} AS r, coalesce(t.trust, -1) AS trust, ingested_at AS w FROM {MATERIAL} s LEFT JOIN source_trust t USING (source_id) WHERE text IS NOT NULL"
    order = "trust DESC, w DESC NULLS LAST, rec_no"
    first = lambda test: f"coalesce((list(rec_no ORDER BY {order}) FILTER ({test}))[1], 0)"
    return f"SELECT min(rec_no) AS group_no, (list(rec_no ORDER BY a::INT + u::INT + r::INT DESC, {order}))[1] AS best_no, {first('a')} AS author_no, {first('u')} AS url_no FROM ({rows}) GROUP BY m HAVING count(*) > 1"


def _related() -> str:
    """(rec_no, split, group_no): everything reached from a record by shared entities."""
    bare = lambda c, prefix: f"regexp_replace(regexp_replace(lower({c}), '\\s+', '', 'g'), '^{prefix}', '')"
    nothing = ", ".join(S.q(x) for x in split_groups.NOTHING)
    split = "MAP {" + ", ".join(f"{S.q(k)}: {S.q(v)}" for k, v in split_groups.SPLITS.items()) + "}[regexp_replace(lower(split), '\\s+', '', 'g')]"
    return f"""n AS (SELECT rec_no, {split} AS split, CASE WHEN {bare('duplicate_cluster', 'cluster-')} NOT IN ({nothing}) THEN 'c' || {bare('duplicate_cluster', 'cluster-')} END AS c, CASE WHEN {bare('work_id', 'fsoft:')} NOT IN ({nothing}) THEN 'w' || {bare('work_id', 'fsoft:')} END AS w FROM {QUALITY}),
l AS (SELECT DISTINCT c AS a, w AS b FROM n WHERE c IS NOT NULL AND w IS NOT NULL), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT x AS node, x AS seen FROM (SELECT c AS x FROM n WHERE c IS NOT NULL UNION SELECT w FROM n WHERE w IS NOT NULL) UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.seen),
h AS (SELECT node, min(seen) AS of FROM reach GROUP BY node), g AS (SELECT rec_no, split, coalesce(h.of, 'r' || rec_no) AS of FROM n LEFT JOIN h ON h.node = coalesce(n.c, n.w)),
t AS (SELECT rec_no, split, min(rec_no) OVER (PARTITION BY of) AS group_no FROM g)"""


def _forms(name: str, keep: str = "") -> str:
    """(id, x, text): every text that is not null in the reader's form.

    The form is put together from the same tables of characters, but folds composed look-alikes one by one
    and without asking the vocabulary.
    """
    blanks, wide = S.q(tf.BLANKS), "".join(chr(0xFF01 + i) for i in range(94))
    composed = {}
    for c in map(chr, [*range(0x370, 0x530), *range(0x1F00, 0x2000)]):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and parts[0] in tf.LOOKALIKES and len(whole := unicodedata.normalize("NFC", tf.fold_lookalikes(parts))) == 1:
            composed[c] = whole
    fold = composed | tf.LOOKALIKES
    plain = f"regexp_replace(text, {S.q(tf.BREAKS)}, chr(10), 'g')"
    plain = f"translate(translate({plain}, {blanks}, repeat(' ', {len(tf.BLANKS)})), {S.q(wide)}, {S.q(''.join(chr(0x21 + i) for i in range(94)))})"
    plain = f"regexp_replace({plain}, {S.q(tf._invisible.pattern)}, '', 'g')"
    plain = f"regexp_replace(regexp_replace({plain}, ' +(\\n)', '\\1', 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"
    bare = f"translate(x, {S.q(''.join(fold))}, '')"
    latin = f"length(regexp_replace({bare}, '[^A-Za-zÀ-ɏḀ-ỿ]', '', 'g'))"
    other = f"length(regexp_replace({bare}, '[^\\pL]', '', 'g')) - {latin}"
    form = f"nfc_normalize(CASE WHEN {latin} > 0 AND {latin} >= {other} THEN translate(x, {S.q(''.join(fold))}, {S.q(''.join(fold.values()))}) ELSE x END)"
    return f"SELECT id{keep}, text, {form} AS x FROM (SELECT rec_no AS id{keep}, text, {plain} AS x FROM {name} WHERE text IS NOT NULL)"


def _terms(name: str, keep: str = "") -> str:
    """(id, n, term) of every record of ten words or more, the k-th occurrence of a word being a term of its own."""
    words = f"SELECT id{keep}, regexp_extract_all(lower(x), '[\\pL\\pN\\pM]+') AS w FROM ({_forms(name, keep)})"
    each = f"SELECT id{keep}, len(w) AS n, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM ({words}) WHERE len(w) >= 10"
    return f"SELECT id{keep}, n, t || '#' || row_number() OVER (PARTITION BY id, t ORDER BY i) AS term FROM ({each})"


def _near(a: str, b: str, extra: str) -> str:
    return f"SELECT x.id AS a, y.id AS b FROM {a} x JOIN {b} y ON x.term = y.term AND {extra} GROUP BY x.id, y.id HAVING count(*) * 10 >= 7 * greatest(any_value(x.n), any_value(y.n))"


def oracle_sql() -> dict[str, str]:
    """SQL for the problems that plain SQL can state; the others are tested against brute force."""
    related = _related()
    point = "(('0x' || substr(sha256('split:' || group_no), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
    grams = "SELECT DISTINCT doc_id, substr(text, i, 100) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 98)) AS i FROM documents WHERE length(text) >= 100)"
    named = "MAP {" + ", ".join(f"{S.q(k)}: {S.q(v)}" for k, v in split_groups.SPLITS.items()) + "}"
    overlap = f"s AS (SELECT *, {named}[regexp_replace(lower(split), '[\\s\\pZ\\p{{Cf}}]+', '', 'g')] AS sp FROM {QUALITY}), t AS MATERIALIZED ({_terms('s', ', sp')}), x1 AS (SELECT * FROM t WHERE sp = 'train'), x2 AS (SELECT * FROM t WHERE sp IN ('dev', 'test')), l AS MATERIALIZED ({_near('x1', 'x2', 'x.id <> y.id')})"
    refs = f"SELECT DISTINCT group_no, r.source_id, r.url, r.unit_type FROM (SELECT group_no, unnest(source_refs) AS r FROM (SELECT source_refs, min(rec_no) OVER w AS group_no, count(*) OVER w AS held FROM (SELECT rec_no, source_refs, lower({S.strip('nfc_normalize(text)')}) AS m FROM {MATERIAL} WHERE text IS NOT NULL) WINDOW w AS (PARTITION BY m)) WHERE held > 1) WHERE coalesce(trim(r.source_id), '') <> '' OR coalesce(trim(r.url), '') <> ''"
    places = "SELECT doc_id, i, substr(text, i, 100) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 98)) AS i FROM documents WHERE length(text) >= 100)"
    return {
        "p3_found": _p3(),
        "p3_refs": refs,
        "p3_survivors": f"WITH f AS MATERIALIZED ({_p3()}), r AS (SELECT group_no, count(*) AS n FROM ({refs}) GROUP BY 1) SELECT f.*, b.source_id, b.unit_type, b.text, b.category, a.author, u.url, coalesce(r.n, 0) AS n_refs FROM f JOIN {MATERIAL} b ON b.rec_no = f.best_no LEFT JOIN {MATERIAL} a ON a.rec_no = f.author_no LEFT JOIN {MATERIAL} u ON u.rec_no = f.url_no LEFT JOIN r ON r.group_no = f.group_no",
        "p1_found": f"WITH RECURSIVE t AS MATERIALIZED ({_terms(WEB)}), l AS MATERIALIZED ({_near('t', 't', 'x.id < y.id')}), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), reach AS (SELECT a AS node, a AS seen FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.seen) SELECT node AS rec_no, min(seen) AS group_no FROM reach GROUP BY node",
        "p2_found": f"WITH t AS MATERIALIZED (SELECT id, x, text FROM ({_forms(WEB)}) WHERE x <> '') SELECT DISTINCT a.id AS rec_a, b.id AS rec_b FROM t a JOIN t b ON a.x = b.x AND a.id < b.id AND a.text <> b.text",
        "p4_found": f"WITH {overlap} SELECT DISTINCT least(a, b) AS rec_a, greatest(a, b) AS rec_b FROM l",
        "p4_report": f"WITH {overlap} SELECT sp AS split, source_id AS source, count(*) AS records, count(*) FILTER (rec_no IN (SELECT b FROM l)) AS overlapping FROM s WHERE sp IN ('dev', 'test') GROUP BY ALL",
        "p5_found": f"WITH RECURSIVE {related} SELECT DISTINCT rec_no, group_no FROM t WHERE group_no IN (SELECT group_no FROM t GROUP BY 1 HAVING count(DISTINCT split) > 1)",
        "p5_splits": f"WITH RECURSIVE {related} SELECT rec_no, group_no, CASE WHEN {point} < 0.8 THEN 'train' WHEN {point} < 0.9 THEN 'dev' ELSE 'test' END AS new_split FROM t",
        "p8_spans": f"WITH f AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text), g AS ({places.replace('documents', 'f')}), n AS (SELECT DISTINCT a.doc_id, b.doc_id AS other, a.i FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id), t AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, other ORDER BY i) AS island FROM n) SELECT doc_id, other, min(i) - 1 AS begin, count(*) + 99 AS size FROM t GROUP BY doc_id, other, island",
        "p8_shared": f"WITH g AS ({places}), k AS (SELECT s FROM g GROUP BY s HAVING count(DISTINCT doc_id) > 1), c AS (SELECT doc_id, least(100, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 100)) AS gain FROM g SEMI JOIN k USING (s)), t AS (SELECT doc_id, sum(gain) AS shared FROM c GROUP BY doc_id), f AS (SELECT text, min(doc_id) AS class_no FROM documents WHERE length(text) >= 100 GROUP BY text) SELECT d.doc_id, f.class_no, coalesce(length(d.text), 0)::BIGINT AS n_chars, coalesce(t.shared, 0)::BIGINT AS shared_chars FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN f ON f.text = d.text",
        "p8_found": f"WITH g AS ({grams}) SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id",
    }
