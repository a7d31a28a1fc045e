"""Prompts, chat messages and feedback for language models, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from versemill.operators.audit import GENERAL
from versemill.operators.agent import coverage_instruction

# The texts of prompts; names in braces are filled in.
TEXTS = {
    "head": "BÀI THƠ LỤC BÁT",
    "recipient": "Người nhận lời chúc: {recipient}",
    "wish": "Ý chúc: {wish}",
    "topic": "Chủ đề: {topic}",
    "lines": "Số câu: {num_lines} (mỗi câu Lục 6 âm tiết, Bát 8 âm tiết)",
    "keywords": "Từ khoá: {keywords}",
    "rhyme": "Vần gợi ý: {rhyme}",
    "poet": "Bạn là một thi sĩ Việt Nam am hiểu thơ Lục Bát. Sáng tác trực tiếp bài thơ Lục Bát đúng luật: dòng 6 âm tiết, dòng 8 âm tiết, vần lưng (tiếng 6 câu Lục với tiếng 6 câu Bát) và vần chân (tiếng 8 câu Bát với tiếng 6 câu Lục kế tiếp). Không dùng thẻ <think>, không giải thích.",
    "gold": "Viết một bài thơ Lục Bát 4 dòng để chúc Tết cho {recipient}. Dùng tự nhiên các từ khóa: {keywords}. Giọng: {tone}.",
    "critic": "Bạn là biên tập viên tiếng Việt. Chỉ đánh giá độ tự nhiên của bài thơ, không sáng tác lại, không dùng <think>, không giải thích ngoài JSON. Phát hiện từ không tự nhiên, cụm ghép gượng, hoặc thiếu người nhận/keyword. Đừng coi văn phong thơ là lỗi chỉ vì ngắn.",
    "critic_user": 'Ý chúc: {wish}\nKeyword: {keywords}\nBài thơ:\n{poem}\nTrả JSON: {"decision":"accept" hoặc "reject", "issues":["..."], "repair_instruction":"một câu ngắn"}.',
    "prose": "Bạn viết tiếng Việt tự nhiên, mạch lạc và giàu hình ảnh. Chỉ trả lời đúng yêu cầu, không dùng thẻ <think>, không giải thích cách làm.",
    "prose_user": "Hãy viết một đoạn văn xuôi ngắn, khoảng 60–90 từ, về chủ đề: {topic}. Không làm thơ, không dùng gạch đầu dòng, không nhắc lại yêu cầu.",
    "scaffold": "Khung neo vần đã được validator chấp nhận; ưu tiên giữ đúng các vị trí này:\n- Dòng 1 kết bằng: {line_1_end}\n- Dòng 2: tiếng 6 là {line_2_sixth}; tiếng 8 là {line_2_end}\n- Dòng 3 kết bằng: {line_3_end}\n- Dòng 4: tiếng 6 là {line_4_sixth}\nĐừng nhồi anchor nếu làm câu vô nghĩa; ưu tiên diễn đạt tự nhiên và luật Lục Bát.",
    "outline": "Dàn ý Qwen (chỉ định hướng, không chép nguyên câu):",
    "outline_line": "Dòng {line}: {role} — {idea} (hình ảnh: {image})",
    "one_poem": "Viết trực tiếp đúng một bài thơ bốn dòng, không JSON, không giải thích, không <think>.",
    "plan": "Bạn là biên tập viên thơ Lục Bát tiếng Việt. Đọc bài thơ nguồn và chỉ xuất JSON hợp lệ, không dùng thẻ think, không giải thích. Không chép lại câu thơ nguồn.",
    "plan_user": 'Mục tiêu: lập dàn ý mềm để sau đó sáng tác MỘT lời chúc Tết Lục Bát đúng 4 dòng.\nHãy rút tinh thần và hình ảnh của bài nguồn, nhưng không mô phỏng tác giả hay sao chép câu chữ.\nSchema JSON bắt buộc:\n{"recipient":"...", "wish_intent":"...", "keywords":["..."], "imagery":["..."], "tone":"...", "line_plan":["dòng 1 ...", "dòng 2 ...", "dòng 3 ...", "dòng 4 ..."]}\nMỗi line_plan là vai trò ngữ nghĩa, không phải câu thơ hoàn chỉnh. Dòng 4 phải có khả năng khép ý.\nBài thơ nguồn:\n{poem}',
    "failed": "Lượt trước không qua gate. {reasons}.",
    "content_kept": "Đã có ứng viên đúng nội dung; giữ nguyên coverage, đừng nhồi thêm từ khoá",
    "content_missing": "Lượt trước thiếu coverage; phân bố người nhận và từ khoá sang các dòng khác nhau",
    "form_first": "ưu tiên sửa toàn bộ vị trí bằng–trắc và đủ ba liên kết vần Lục Bát, tránh thêm ý mới",
    "repair": "Bản strict trước bị biên tập viên từ chối. Giữ luật 6–8/vần/thanh và coverage, nhưng sửa các lỗi: {issues}. Yêu cầu sửa: {repair}. Không lặp lại nguyên văn bản lỗi này:\n{poem}",
    "some_issue": "có từ/cụm không tự nhiên",
    "some_repair": "Dùng từ tiếng Việt thông dụng, tự nhiên.",
    "orphan": "không dùng âm tiết đứng riêng: {token}",
    "truncated": "không cắt keyword: {keyword}",
    "certain": "Lỗi tất định phải sửa: {issues}.",
}


def fill(name: str, **values: Column) -> Column:
    """The text of that name with its names in braces filled in; null if a value is null."""
    parts = re.split(r"\{([a-z_0-9]+)\}", TEXTS[name])
    return F.concat(*[values[p].cast("string") if k % 2 else F.lit(p) for k, p in enumerate(parts) if k % 2 or p])


def _given(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def _listed(words: Column) -> Column:
    return F.array_join(F.coalesce(words, F.array().cast("array<string>")), ", ")


def poem_prompt(recipient: Column, wish: Column, topic: Column, num_lines: Column, keywords: Column, rhyme: Column) -> Column:
    """The structured prompt of a request; what is null or empty has no line."""
    some = F.coalesce(F.size(keywords), F.lit(0)) > 0
    return F.concat_ws(
        "\n", F.lit(TEXTS["head"]), F.when(_given(recipient), fill("recipient", recipient=recipient)), F.when(_given(wish), fill("wish", wish=wish)), F.when(_given(topic), fill("topic", topic=topic)),
        fill("lines", num_lines=num_lines), F.when(some, fill("keywords", keywords=_listed(keywords))), F.when(_given(rhyme), fill("rhyme", rhyme=rhyme)),
    )


def messages(system: str, user: Column) -> Column:
    """A system turn by the name of its text and a user turn."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(TEXTS[system])), turn("user", user))


def chat_text(turns: Column) -> Column:
    """Chat turns as one text that ends where the assistant begins; null if one of them has no content."""
    said = F.transform(turns, lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["content"], F.lit("<|im_end|>\n")))
    whole = F.concat(F.array_join(said, ""), F.lit("<|im_start|>assistant\n"))
    return F.when(F.forall(turns, lambda t: t["content"].isNotNull()), whole)


def gold_prompt(recipient: Column, keywords: Column, tone: Column) -> Column:
    """The prompt of a reviewed example; general recipients are wished to as one."""
    whom = F.when(F.lower(recipient).isin("chung chung", *GENERAL), GENERAL[0]).otherwise(recipient)
    return fill("gold", recipient=whom, keywords=_listed(keywords), tone=tone)


def critic_messages(poem: Column, wish: Column, keywords: Column) -> Column:
    return messages("critic", fill("critic_user", wish=F.coalesce(wish, F.lit("")), keywords=_listed(keywords), poem=poem))


def prose_messages(topic: Column) -> Column:
    return messages("prose", fill("prose_user", topic=topic))


def plan_messages(poem: Column) -> Column:
    return messages("plan", fill("plan_user", poem=poem))


def poetry_prompt(prompt: Column, recipients: Column, keywords: Column, line_plan: Column, scaffold: Column, feedback: Column) -> Column:
    """The prompt for a poem by a plan: request, coverage, outline of its lines, scaffold and, if any, feedback."""
    outline = F.transform(line_plan, lambda x: fill("outline_line", line=x["line"], role=x["role"], idea=x["idea"], image=x["image"]))
    anchors = {n: scaffold[n] for n in ("line_1_end", "line_2_sixth", "line_2_end", "line_3_end", "line_4_sixth")}
    return F.concat_ws("\n", prompt, coverage_instruction(recipients, keywords), F.lit(TEXTS["outline"]), F.array_join(outline, "\n"), fill("scaffold", **anchors), F.when(_given(feedback), feedback), F.lit(TEXTS["one_poem"]))


def retry_feedback(recipients: Column, keywords: Column, content_passed: Column, form_failed: Column) -> Column:
    """What the next attempt is told: whether some candidate had the content, and whether one lacked the form."""
    content = F.when(content_passed, F.lit(TEXTS["content_kept"])).otherwise(F.lit(TEXTS["content_missing"]))
    reasons = F.concat_ws("; ", coverage_instruction(recipients, keywords), content, F.when(form_failed, F.lit(TEXTS["form_first"])))
    return fill("failed", reasons=reasons)


def repair_feedback(poem: Column, critic: Column) -> Column:
    """What a poem's rejection asks to mend, by its first four issues; null unless it was rejected."""
    named = F.array_join(F.slice(F.coalesce(critic["issues"], F.array().cast("array<string>")), 1, 4), "; ")
    issues = F.when(named == "", TEXTS["some_issue"]).otherwise(named)
    return F.when(critic["decision"] == "reject", fill("repair", issues=issues, repair=F.coalesce(critic["repair_instruction"], F.lit(TEXTS["some_repair"])), poem=poem))


def strict_repair_feedback(recipients: Column, keywords: Column, content_passed: Column, form_failed: Column, issues: Column, poem: Column, critic: Column) -> Column:
    """Feedback with the certain errors of an attempt first; a critic adds to it only by a rejection.

    `issues` are structs of type, token and keyword.
    """
    told = F.transform(issues, lambda x: F.when(x["type"] == "orphan_vowel", fill("orphan", token=x["token"])).when(x["type"] == "truncated_keyword", fill("truncated", keyword=x["keyword"])))
    certain = F.array_compact(F.coalesce(told, F.array().cast("array<string>")))
    return F.concat_ws("\n", retry_feedback(recipients, keywords, content_passed, form_failed), F.when(F.size(certain) > 0, fill("certain", issues=F.array_join(certain, "; "))), repair_feedback(poem, critic))
