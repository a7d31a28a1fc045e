"""Metadata, prompts, plans and critiques as columns; retrieval of material; accepting attempts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versemill.functions import tables as T
from versemill.functions import text as tx
from versemill.plans.lineage import cut

#: Wishes and materials that meet in one task of retrieve_many().
WISH_BLOCK, MATERIAL_BLOCK = 256, 4096

# Words of a request that are no keywords.
REQUEST_STOP = [
    "viết", "bài", "thơ", "lục", "bát", "về", "một", "của", "để", "cho", "và", "có", "là", "trong", "trên", "những", "các",
    "này", "đó", "như", "bạn", "tôi", "em", "anh", "câu", "dòng", "đi", "với", "ở", "được", "vần",
]
# Heads of lines that are not verse.
HEADERS = ["bài thơ lục bát", "chủ đề", "số câu", "từ khoá", "vần gợi ý", "sáng tác"]
# Signals of the domain.
SIGNALS = {
    "tet_direct": ["tết", "giao thừa", "năm mới", "tân niên", "nguyên đán", "lì xì", "mừng tuổi", "bánh chưng", "bánh tét"],
    "spring_explicit": ["mùa xuân", "xuân", "hoa đào", "hoa mai", "chồi non", "cánh én", "mưa xuân", "nắng xuân"],
    "reunion": ["đoàn viên", "sum vầy", "sum họp", "quây quần", "gia đình"],
}
# Folded terms that choose a guide, and its keywords.
GUIDES = [
    (["ong", "ba", "cha", "me", "gia", "dinh", "con", "chau"], ["mai vàng", "chén trà", "sum vầy", "lộc xuân", "mái nhà", "con cháu"]),
    (["ban", "dong", "nghiep", "ban be"], ["nắng xuân", "nụ cười", "lộc mới", "đường xa", "tin vui", "chén trà"]),
    (["suc", "khoe", "binh", "an", "phuc", "loc", "thanh", "cong"], ["nắng xuân", "mai vàng", "lộc biếc", "an khang", "niềm vui", "đường mới"]),
]
DEFAULT_GUIDE = ["mai vàng", "nắng xuân", "chén trà", "lộc biếc", "sum vầy", "niềm vui"]
_LOW = r"a-z\x{e0}-\x{1ef9}"


def parse_request(prompt: Column) -> Column:
    """topic, num_lines (4 if none is named), keywords (the first five), rhyme of a free request."""
    low = F.lower(prompt)
    number = F.regexp_extract(low, f"([0-9]+){T.WS}*(?:câu|dòng)", 1)
    rhyme = F.regexp_extract(low, f"vần{T.WS}+([{_LOW}]{{1,4}})({T.EDGE}|$)", 1)
    words = F.filter(F.split(low, f"[^{_LOW}]+"), lambda w: (w != "") & ~w.isin(REQUEST_STOP))
    return F.struct(
        tx.strip(prompt).alias("topic"),
        F.when(number == "", 4).otherwise(F.try_to_number(number, F.lit("999999999999")).cast("long")).cast("long").alias("num_lines"),
        F.slice(words, 1, 5).alias("keywords"),
        F.when(rhyme != "", rhyme).alias("rhyme"),
    )


def extract_poem(raw: Column, most: int = 8) -> Column:
    """The verse of a model's raw output: no thoughts, tags, heads or blank lines, at most `most` lines."""
    bare = F.regexp_replace(raw, "(?is)<think>.*?</think>", "")
    bare = F.regexp_replace(bare, r"</?answer>|<\|im_(?:start|end)\|>", "")
    head = "^(" + "|".join(HEADERS) + ")"
    lines = F.filter(F.transform(tx.any_lines(bare), tx.strip), lambda x: (x != "") & ~F.lower(x).rlike(head))
    return F.array_join(F.slice(lines, 1, most), "\n")


def request_topic(prompt: Column) -> Column:
    """What a request is about: without the opening, the number of lines, the verb and full stops at its end."""
    text = tx.strip(prompt)
    text = tx.strip(F.regexp_replace(text, "(?iu)^viết bài thơ lục bát", ""))
    text = F.regexp_replace(text, f"(?iu)^[0-9]+{T.WS}*(?:câu|dòng){T.WS}*", "")
    text = F.regexp_replace(text, f"(?iu)^(?:về|tả|nhớ){T.WS}+", "")
    return F.regexp_replace(text, r"\.+$", "")


# Syllables and signs that do not belong to the head of an answer.
STRAY = r"nghèn|nghẹn|nghẽn|[^\p{L}\p{N}_\x{c0}-\x{1ef9}\t-\r\x1c-\x20]+"


def clean_output(raw: Column) -> Column:
    """A model's answer after its thoughts, without stray signs at its head, its first letter in upper case."""
    text = tx.strip(F.regexp_replace(tx.strip(raw), "(?s)^.*</think>", ""))
    text = F.regexp_replace(text, f"(?iu)^({STRAY}){T.WS}*", "")
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2**31 - 1))


def manifest_faults(prompts: DataFrame, version: Column, split: Column, wanted_split: str | None = None) -> DataFrame:
    """(id, fault): what is wrong with the prompts (id, prompt, wish_intent, recipient, keywords, num_lines,
    protocol_version) of a manifest; no rows for a sound one. A manifest without prompts is not sound
    either, which its empty table says."""
    m = normalize_metadata(*[F.col(c) for c in ("wish_intent", "recipient", "keywords", "num_lines", "protocol_version")])
    rows = tx.settle(prompts.withColumn("_n", F.count("*").over(Window.partitionBy("id"))), m=m, version=version, split=split)
    blank = lambda c: tx.squeeze(F.coalesce(c, F.lit(""))) == ""
    fault = F.when(F.coalesce("version", F.lit("")) != "tet4-v1", "version")
    if wanted_split is not None:
        fault = fault.when(F.coalesce("split", F.lit("")) != wanted_split, "split")
    fault = fault.when(blank(F.col("id")), "id").when(F.col("_n") > 1, "repeated_id").when(blank(F.col("prompt")), "prompt").otherwise(F.col("m.fault"))
    return rows.select("id", fault.alias("fault")).where("fault IS NOT NULL").distinct()


# What a prompt says about the people and keywords that a poem has to name.
COVERAGE = {
    "whole": "Ràng buộc nội dung: %s.",
    "named": "phải nhắc rõ %s",
    "exact": "phải dùng nguyên văn ít nhất một từ khoá: %s",
    "loose": "phải phủ ít nhất %d/%d ý từ khoá; phần còn lại được paraphrase",
}


def coverage_instruction(recipients: Column, keywords: Column) -> Column:
    """What a prompt says about the people and keywords that a poem has to name."""
    named = F.when(F.size(recipients) > 0, F.format_string(COVERAGE["named"], F.array_join(recipients, ", ")))
    exact = F.format_string(COVERAGE["exact"], F.array_join(keywords, ", "))
    loose = F.format_string(COVERAGE["loose"], F.least(F.lit(2), F.size(keywords)), F.size(keywords))
    return F.format_string(COVERAGE["whole"], F.concat_ws("; ", named, exact, loose))


def title_topic(title: Column) -> Column:
    """A title as topic; the genre where there is none; 160 characters at most."""
    text = tx.squeeze(F.coalesce(title, F.lit("")))
    return F.when(text.isin("") | F.lower(text).isin("null", "none", "bài thơ"), "thơ lục bát").otherwise(F.substring(text, 1, 160))


def top_keywords(df: DataFrame, key: str, text: str = "text", k: int = 3) -> DataFrame:
    """(id, place, word, n): the k commonest words of two letters or more, earlier ones first on ties."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(T.WORD_ANY), F.lit(0))
    rows = df.select(F.col(key).alias("id"), F.posexplode(words).alias("pos", "word"))
    rows = rows.where((F.length("word") >= 2) & ~F.col("word").isin(T.STOP_WORDS))
    counted = rows.groupBy("id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    w = Window.partitionBy("id").orderBy(F.desc("n"), "first")
    return counted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def chat_messages(df: DataFrame, key: str, text: str, title: str, topics: DataFrame | None = None) -> DataFrame:
    """(id, messages, num_lines): system, user and assistant turns of a training example."""
    words = top_keywords(df, key, text).groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), ", ").alias("words"))
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"), title_topic(F.col(title)).alias("topic"), F.size(tx.any_lines(F.col(text))).alias("num_lines")).join(words, "id", "left")
    user = F.concat_ws("\n", F.lit("BÀI THƠ LỤC BÁT"), F.concat(F.lit("Chủ đề: "), "topic"), F.format_string("Số câu: %d", "num_lines"), F.concat(F.lit("Từ khoá: "), F.coalesce("words", F.lit(""))))
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(turn("system", F.lit("Sáng tác bài thơ lục bát đúng luật, không giải thích.")), turn("user", user), turn("assistant", F.col("text")))
    return rows.select("id", messages.alias("messages"), "num_lines")


def signals(text: Column) -> Column:
    """The names of the domain signals in a text."""
    return F.array_compact(F.array(*[F.when(tx.has_word(text, words), name) for name, words in SIGNALS.items()]))


def in_domain(found: Column) -> Column:
    """The season named, or spring together with reunion."""
    return F.array_contains(found, "tet_direct") | (F.array_contains(found, "spring_explicit") & F.array_contains(found, "reunion"))


def clean_keywords(keywords: Column) -> tuple[Column, Column]:
    """(keywords squeezed, the first of each spelling kept whatever its case; whether two or three are left)."""
    squeezed = F.filter(F.transform(keywords, lambda k: tx.squeeze(k)), lambda k: k != "")
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("kept"))
    add = lambda s, k: F.struct(F.concat(s["seen"], F.array(F.lower(k))).alias("seen"), F.concat(s["kept"], F.array(k)).alias("kept"))
    kept = F.aggregate(squeezed, start, lambda s, k: F.when(F.array_contains(s["seen"], F.lower(k)), s).otherwise(add(s, k)), lambda s: s["kept"])
    return kept, F.size(kept).isin(2, 3)


def normalize_metadata(intent: Column, recipient: Column, keywords: Column, num_lines: Column, version: Column) -> Column:
    """The protocol's metadata with the first fault, null for none: a wish, two or three keywords, four lines."""
    wish = tx.squeeze(F.coalesce(intent, F.lit("")))
    kept, enough = clean_keywords(F.coalesce(keywords, F.array().cast("array<string>")))
    fault = F.when(wish == "", "wish_intent").when(recipient.isNotNull() & (tx.squeeze(recipient) == ""), "recipient")
    fault = fault.when(~enough, "keywords").when(F.coalesce(num_lines, F.lit(4)) != 4, "num_lines").when(F.coalesce(version, F.lit("tet4-v1")) != "tet4-v1", "protocol_version")
    whole = F.when(recipient.isNotNull(), F.concat(F.lit("Chúc "), tx.squeeze(recipient), F.lit(": "), wish)).otherwise(wish)
    return F.struct(whole.alias("wish_intent"), kept.alias("keywords"), fault.alias("fault"))


PLAN = "struct<recipient:string,wish_intent:string,keywords:array<string>,imagery:array<string>,tone:string,line_plan:array<struct<line:int,role:string,idea:string,image:string>>>"


def parse_plan(raw: Column, lines: int = 4) -> Column:
    """The plan in a model's output, from its first brace to its last; null unless all keys and lines are there."""
    plan = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), PLAN)
    full = F.lit(True)
    for k in ("recipient", "wish_intent", "keywords", "imagery", "tone", "line_plan"):
        full = full & plan[k].isNotNull()
    sound = F.forall(plan["line_plan"], lambda x: x["line"].isNotNull() & x["role"].isNotNull() & x["idea"].isNotNull() & x["image"].isNotNull())
    return F.when(full & (F.size(plan["line_plan"]) == lines) & sound, plan)


LOOSE_PLAN = PLAN[: PLAN.index("line_plan")] + "line_plan:array<string>>"


def parse_loose_plan(raw: Column, lines: int = 4) -> Column:
    """A plan whose lines are sentences, or anything else that JSON has, as text; null unless all keys are there and
    there are as many lines as wanted."""
    plan = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), LOOSE_PLAN)
    full = F.lit(True)
    for k in ("recipient", "wish_intent", "keywords", "imagery", "tone", "line_plan"):
        full = full & plan[k].isNotNull()
    return F.when(full & (F.size(plan["line_plan"]) == lines), plan)


CRITIC = "struct<decision:string,issues:array<string>,repair_instruction:string>"
# How the parts of a broken verdict are found, and what stands for those that are missing.
BROKEN = {
    "decision": r'"decision"\s*:\s*"(accept|reject)"',
    "issues": r'(?s)"issues"\s*:\s*\[(.*?)\]\s*,\s*"repair_instruction"',
    "repair_instruction": r'(?s)"repair_instruction"\s*:\s*"(.*?)"\s*\}',
}
MISSING = {"issues": "có từ hoặc cụm ghép không tự nhiên", "repair_instruction": "Dùng từ tiếng Việt thông dụng, tự nhiên."}


def parse_critic(raw: Column) -> Column:
    """A critic's verdict. Broken output can be saved as a rejection only, never as an acceptance."""
    c = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), CRITIC)
    whole = c["issues"].isNotNull() & F.forall(c["issues"], lambda x: x.isNotNull()) & c["repair_instruction"].isNotNull()
    sound = F.coalesce(c["decision"].isin("accept", "reject") & whole, F.lit(False))
    found = {name: F.regexp_extract(raw, pattern, 1) for name, pattern in BROKEN.items()}
    issues, repair = (F.when(found[name] == "", default).otherwise(found[name]) for name, default in MISSING.items())
    issue = F.regexp_replace(F.regexp_replace(issues, r"\s+", " "), r'^[ ,"]+|[ ,"]+$', "")
    saved = F.struct(F.lit("reject").alias("decision"), F.array(issue).alias("issues"), repair.alias("repair_instruction"))
    return F.when(sound, c).when(found["decision"] == "reject", saved)


def guide(wish: Column) -> Column:
    """The keywords of the guide that shares most terms with a wish, the first of equals; a default for none."""
    words = tx.terms(wish)
    hits = [F.size(F.array_intersect(words, F.array(*map(F.lit, g)))) for g, _ in GUIDES]
    most = F.greatest(*hits)
    chosen = F.when(most == 0, F.array(*map(F.lit, DEFAULT_GUIDE)))
    for h, (_, keys) in zip(hits, GUIDES):
        chosen = chosen.when(h == most, F.array(*map(F.lit, keys)))
    return chosen


def retrieve(wishes: DataFrame, materials: DataFrame, k: int = 3) -> DataFrame:
    """(wish_id, material_id, score, place): materials that share most terms with a wish, one point more for
    a named author, then by identifier. For a few stated wishes; retrieve_many() is for many.

    Terms meet in an inverted list. Materials that share none have their point at most, so the first k of all
    by that point fill up what is lacking. A null wish has no terms.
    """
    searchable = tx.terms(F.concat_ws(" ", "text", "author", "url"))
    bonus = (F.coalesce("author", F.lit("")) != "").cast("int")
    rows = tx.settle(materials.select("material_id", "text", "author", "url"), terms=searchable, bonus=bonus).select("material_id", "bonus", F.explode_outer("terms").alias("term"))
    asked = wishes.select("wish_id", F.explode(tx.terms(F.col("wish"))).alias("term"))
    shared = rows.join(asked, "term").groupBy("wish_id", "material_id").agg((F.count("*") + F.max("bonus")).alias("score"))
    filler = materials.select("material_id", bonus.cast("long").alias("score")).orderBy(F.desc("score"), "material_id").limit(k)
    every = shared.union(wishes.select("wish_id").distinct().join(F.broadcast(filler)).select("wish_id", "material_id", "score"))
    every = every.groupBy("wish_id", "material_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("wish_id").orderBy(F.desc("score"), "material_id")
    return every.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def retrieve_many(wishes: DataFrame, materials: DataFrame, k: int = 3, wish_block: int = WISH_BLOCK, material_block: int = MATERIAL_BLOCK) -> DataFrame:
    """As retrieve(), for wishes that grow with the materials.

    Blocks of wishes meet blocks of materials, each pair in a task of its own: the terms of both are two
    matrices, whose product holds the scores. Only the first k of each wish leave a pair of blocks.
    """
    searchable = tx.terms(F.concat_ws(" ", "text", "author", "url"))
    bonus = (F.coalesce("author", F.lit("")) != "").cast("int")
    rows = cut(tx.settle(materials.select("material_id", "text", "author", "url"), terms=searchable, bonus=bonus).select(F.col("material_id").cast("long"), "bonus", "terms"), "materials")
    asked = cut(tx.settle(wishes, wanted=F.coalesce(tx.terms(F.col("wish")), F.array().cast("array<string>"))).select(F.col("wish_id").cast("long"), "wanted"), "wishes")
    down, across = (max(1, -(-df.count() // size)) for df, size in ((asked, wish_block), (rows, material_block)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("across", own("material_id", across)).withColumn("down", every(down))
    right = asked.withColumn("down", own("wish_id", down)).withColumn("across", every(across))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("material_id")
        ids, wish_ids, extra = (t[c].to_numpy() for t, c in ((left, "material_id"), (right, "wish_id"), (left, "bonus")))
        known = pc.unique(pc.list_flatten(right["wanted"]))
        wanted = np.zeros((len(wish_ids), len(known)), np.float32)
        wanted[pc.list_parent_indices(right["wanted"]).to_numpy(), pc.index_in(pc.list_flatten(right["wanted"]), value_set=known).to_numpy()] = 1
        owner = pc.list_parent_indices(left["terms"]).to_numpy()
        term = pc.fill_null(pc.index_in(pc.list_flatten(left["terms"]), value_set=known), -1).to_numpy()
        owner, term = owner[term >= 0], term[term >= 0]
        scores = np.zeros((len(wish_ids), len(ids)), np.int64)
        for begin in range(0, len(ids), 512):
            end = min(begin + 512, len(ids))
            own = slice(*np.searchsorted(owner, [begin, end]))
            held = np.zeros((len(known), end - begin), np.float32)
            held[term[own], owner[own] - begin] = 1
            scores[:, begin:end] = np.rint(wanted @ held).astype(np.int64) + extra[begin:end]
        first = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(scores, first, axis=1)
        return pa.table({"wish_id": np.repeat(wish_ids, first.shape[1]), "material_id": ids[first.ravel()], "score": found.ravel()})

    scored = left.groupBy("down", "across").cogroup(right.groupBy("down", "across")).applyInArrow(best, "wish_id long, material_id long, score long")
    w = Window.partitionBy("wish_id").orderBy(F.desc("score"), "material_id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def accepted_attempts(attempts: DataFrame, pool: str = "pool", attempt: str = "attempt") -> DataFrame:
    """(pool, attempts, accepted_at): the first accepted attempt of each pool that no critic vetoed, null for none."""
    good = F.col("accepted") & ~F.coalesce(F.col("vetoed"), F.lit(False))
    return attempts.groupBy(pool).agg(F.count("*").alias("attempts"), F.min(F.when(good, F.col(attempt))).alias("accepted_at"))


def retried_until_eligible(candidates: DataFrame, retries: int, pool: str = "pool", attempt: str = "attempt", idx: str = "idx") -> DataFrame:
    """(pool, attempts, candidates, available, best): what a run that adds attempts until a candidate is valid and free of
    certain errors would have made of each pool; at most `retries` attempts after the first.

    Candidates have `score`, `valid` and `hard_fail`, attempts count from 1. The best is the eligible candidate of the highest score
    among those made, the first of equals; without one, the best of all.
    """
    good = F.col("valid") & ~F.coalesce("hard_fail", F.lit(False))
    last = candidates.groupBy(pool).agg(F.least(F.coalesce(F.min(F.when(good, F.col(attempt))), F.max(attempt)), F.lit(retries + 1)).alias("attempts"))
    made = candidates.join(last, pool).where(F.col(attempt) <= F.col("attempts"))
    best = F.max(F.struct(good.alias("good"), "score", (-F.col(idx)).alias("i")))
    return made.groupBy(pool).agg(F.max("attempts").alias("attempts"), F.count("*").alias("candidates"), F.bool_or(good).alias("available"), (-best["i"]).alias("best"))


def plan_sources(df: DataFrame, order: str, text: str = "text", unit: str = "unit_type", least_lines: int = 5, limit: int = 15) -> DataFrame:
    """`df` with `pilot_id`: the first full poems, in order, that have enough lines, as sources of plans."""
    rows = df.where((F.col(unit) == "raw_labeled_full_poem") & (F.size(tx.any_lines(F.col(text))) >= least_lines)).orderBy(order).limit(limit)
    return rows.withColumn("pilot_id", F.format_string("PLAN-%03d", F.row_number().over(Window.orderBy(order))))


def domain_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """One row: records and tokens (parted by white space) of a table, and of its different texts."""
    tokens = F.size(F.filter(F.split(F.col(text), f"{T.WS}+"), lambda w: w != "")).cast("long")
    each = df.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("digest")).agg(F.count("*").alias("n"), F.first(tokens).alias("tokens"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(name)
    return each.agg(total(F.col("n"), "records"), F.count("*").alias("unique_records"), total(F.col("n") * F.col("tokens"), "tokens"), total(F.col("tokens"), "unique_tokens"))
