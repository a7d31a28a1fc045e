"""Prompts and feedback by literal values."""

from pyspark.sql import functions as F

from versemill.operators import agent as ag
from versemill.operators import prompts as pr



def keys():
    return F.array(F.lit("con cháu"), F.lit("sum vầy"), F.lit("lộc xuân"))


def none():
    return F.lit(None).cast("string")


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_prompt_has_lines_for_what_is_given(spark):
    r = one(spark, full=pr.poem_prompt(F.lit("ông bà"), F.lit("bình an"), F.lit("Tết"), F.lit(4), keys(), F.lit("an")), bare=pr.poem_prompt(none(), F.lit(""), none(), F.lit(8), F.array().cast("array<string>"), none()))
    assert r.full.split("\n") == [
        "BÀI THƠ LỤC BÁT", "Người nhận lời chúc: ông bà", "Ý chúc: bình an", "Chủ đề: Tết", "Số câu: 4 (mỗi câu Lục 6 âm tiết, Bát 8 âm tiết)", "Từ khoá: con cháu, sum vầy, lộc xuân", "Vần gợi ý: an",
    ]
    assert r.bare == "BÀI THƠ LỤC BÁT\nSố câu: 8 (mỗi câu Lục 6 âm tiết, Bát 8 âm tiết)"


def test_chat_and_messages(spark):
    turns = pr.critic_messages(F.lit("ông bà sum vầy"), F.lit("chúc ông bà"), F.array(F.lit("sum vầy")))
    r = one(spark, turns=turns, chat=pr.chat_text(pr.messages("poet", F.lit("x"))), gold=pr.gold_prompt(F.lit("Mọi người"), keys(), F.lit("Chân thành")))
    assert "không sáng tác lại" in r.turns[0].content and "ông bà sum vầy" in r.turns[1].content and r.turns[1].content.endswith('"repair_instruction":"một câu ngắn"}.')
    assert r.chat.startswith("<|im_start|>system\nBạn là một thi sĩ") and r.chat.endswith("<|im_end|>\n<|im_start|>user\nx<|im_end|>\n<|im_start|>assistant\n")
    assert r.gold == "Viết một bài thơ Lục Bát 4 dòng để chúc Tết cho mọi nhà. Dùng tự nhiên các từ khóa: con cháu, sum vầy, lộc xuân. Giọng: Chân thành."


def test_retry_keeps_content_without_more_keywords(spark):
    people = F.array(F.lit("ông bà"))
    r = one(spark, contract=ag.coverage_instruction(people, keys()), kept=pr.retry_feedback(people, keys(), F.lit(True), F.lit(True)), missing=pr.retry_feedback(people, keys(), F.lit(False), F.lit(False)))
    assert r.contract == "Ràng buộc nội dung: phải nhắc rõ ông bà; phải dùng nguyên văn ít nhất một từ khoá: con cháu, sum vầy, lộc xuân; phải phủ ít nhất 2/3 ý từ khoá; phần còn lại được paraphrase."
    assert "giữ nguyên coverage, đừng nhồi thêm từ khoá" in r.kept and "ba liên kết vần" in r.kept and r.kept.startswith("Lượt trước không qua gate. Ràng buộc")
    assert "thiếu coverage" in r.missing and "ba liên kết vần" not in r.missing


def test_repair_asks_for_rejections_only(spark):
    raw = '{"decision":"reject","issues":["cụm bàn thài không tự nhiên"],"repair_instruction":"dùng từ thông dụng"}'
    accepted = '{"decision":"accept","issues":[],"repair_instruction":""}'
    issue = F.array(F.struct(F.lit("orphan_vowel").alias("type"), F.lit("ơ").alias("token"), none().alias("keyword")))
    nobody = F.array().cast("array<string>")
    r = one(spark, told=pr.repair_feedback(F.lit("bàn thài ông ơ"), ag.parse_critic(F.lit(raw))), none=pr.repair_feedback(F.lit("x"), ag.parse_critic(F.lit(accepted))),
            strict=pr.strict_repair_feedback(nobody, keys(), F.lit(True), F.lit(True), issue, F.lit("bàn thài ông ơ"), ag.parse_critic(F.lit(accepted))))
    assert "cụm bàn thài không tự nhiên" in r.told and r.told.endswith("Không lặp lại nguyên văn bản lỗi này:\nbàn thài ông ơ")
    assert r.none is None and r.strict.endswith("Lỗi tất định phải sửa: không dùng âm tiết đứng riêng: ơ.")


def test_critic_saves_a_clear_rejection(spark):
    broken = '{"decision":"reject", "issues":["cụm "bữa thơi" gượng"], "repair_instruction":"dùng cụm tự nhiên"}'
    r = one(spark, saved=ag.parse_critic(F.lit(broken)), other=ag.parse_critic(F.lit('{"decision":"maybe"}')), lost=ag.parse_critic(F.lit(broken.replace("reject", "accept"))))
    assert r.saved.decision == "reject" and r.saved.issues == ['cụm "bữa thơi" gượng'] and r.saved.repair_instruction == "dùng cụm tự nhiên"
    assert r.other is None and r.lost is None


def test_poetry_prompt_shows_plan_and_scaffold(spark):
    line = lambda k: F.struct(F.lit(k).alias("line"), F.lit("mở").alias("role"), F.lit("ý").alias("idea"), F.lit("hoa").alias("image"))
    anchors = F.struct(*[F.lit(v).alias(k) for k, v in {"line_1_end": "xuân", "line_2_sixth": "xuân", "line_2_end": "nhà", "line_3_end": "qua", "line_4_sixth": "ca"}.items()])
    r = one(spark, p=pr.poetry_prompt(F.lit("P"), F.array().cast("array<string>"), keys(), F.array(line(1), line(2)), anchors, none()))
    lines = r.p.split("\n")
    assert lines[0] == "P" and "Dòng 2: mở — ý (hình ảnh: hoa)" in lines and "- Dòng 2: tiếng 6 là xuân; tiếng 8 là nhà" in lines and lines[-1].startswith("Viết trực tiếp đúng một bài thơ bốn dòng")
