import random
import re

import pytest
from pyspark.sql import functions as F

from quillsift.config import RepairPolicy
from quillsift.functions import answers as an, loops, text as tx
from quillsift.operators import evidence as ev

SENTENCE = "Người sử dụng lao động phải trả lương đúng hạn và đầy đủ cho người lao động theo hợp đồng"


def test_clean_answer_keeps_numbers(one):
    got = one(an.clean_answer, "**Trả lời:**\n- Theo Điều 2 Nghị định 12/2020/NĐ-CP, phạt 1.000.000 đồng.",
              "<think>x</think>## Tên\n\n\n\n[luật](https://a.vn) xem https://b.vn/c ngay")
    assert got == ["Theo Điều 2 Nghị định 12/2020/NĐ-CP, phạt 1.000.000 đồng.", "Tên\n\nluật xem  ngay"]


def test_flags(spark):
    rows = spark.createDataFrame([("Theo 99/2025/NĐ-CP ngày 01/08/2022", "12/2020/NĐ-CP"), ("Không có thông tin về việc này.", ""),
                                  ("Cơ quan không đủ thông tin thì từ chối.", ""), ("  ", ""), ("```x", "")], "a string, e string")
    got = [r.f for r in rows.select(an.answer_flags(F.col("a"), F.col("e")).alias("f")).collect()]
    assert [g.unsupported_document_numbers for g in got] == [["99/2025/nđ-cp"], [], [], [], []]
    assert [g.refusal for g in got] == [False, True, False, False, False]
    assert [g.empty for g in got] == [False, False, False, True, False] and got[4].artifact and not got[0].artifact


def test_unfinished_and_completed(one):
    assert one(an.is_unfinished, "", "Gồm:", "Quy định như sau.", "Cụ thể là ; ", "Xong.") == [True, True, True, True, False]
    long = " ".join(f"từ{i}" for i in range(24))
    assert one(an.completed_prefix, long + ". Còn dở", long + "\ndở dang", "ngắn. dở", long) == [long + ".", long, "", ""]


def test_route_precedence(spark):
    flags = "struct<empty:boolean,unsupported_document_numbers:array<string>,refusal:boolean,artifact:boolean>"
    ok, bad, no = (False, [], False, False), (True, [], False, False), (False, [], True, False)
    cases = [((True, True, bad, True, True), "entity_guard_fallback"), ((False, True, ok, False, True), "generated_truncated"),
             ((False, True, ok, False, False), "source_fallback"), ((False, True, bad, False, True), "source_fallback"),
             ((False, False, no, True, True), "source_fallback"), ((False, True, no, False, True), "generated_refusal"),
             ((False, False, ok, False, False), "generated")]
    df = spark.createDataFrame([c for c, _ in cases], f"c boolean, h boolean, f {flags}, s boolean, p boolean")
    got = [r.v for r in df.select(an.route(*[F.col(x) for x in "chfsp"]).alias("v")).collect()]
    assert got == [w for _, w in cases]


def plain_removal(text, policy):
    """Direct statement of the rule: narrowest repeated block at each place, from left to right."""
    for pattern in (r"[^\r\n]+", r"\S[\s\S]*?(?:[.!?](?=\s|$)|$)"):
        units = [m for m in re.finditer(pattern, text) if m.group().strip()]
        words = [m.group().strip() for m in units]
        gone, i = [], 0
        while i < len(units):
            for w in range(1, policy.max_block + 1):
                k = 1
                while words[i + k * w:i + (k + 1) * w] == words[i:i + w]:
                    k += 1
                size = " ".join(words[i:i + w])
                if k >= policy.min_repeats and len(size) >= policy.min_chars and len(size.split()) >= policy.min_words:
                    gone.append((units[i + w - 1].end(), units[i + w * k - 1].end()))
                    i += w * k
                    break
            else:
                i += 1
        for a, b in reversed(gone):
            text = text[:a] + text[b:]
    return text


def test_removal_equals_the_plain_rule(spark):
    r, pool = random.Random(7), [f"{SENTENCE} số {i}" for i in range(3)] + ["Ngắn", "Một câu vừa phải thôi nhé các bạn"]
    texts = []
    for _ in range(150):
        block = r.choices(pool, k=r.randint(1, 4))
        parts = r.choices(pool, k=r.randint(0, 3)) + block * r.randint(1, 5) + r.choices(pool, k=r.randint(0, 3))
        texts.append(r.choice(["\n", ". ", ".\n", "\r\n"]).join(parts) + r.choice(["", ".", "\n", ".\n\n"]))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {x.i: x.proposed for x in loops.with_loops_removed(df, "t").collect()}
    want = {i: plain_removal(t, RepairPolicy()) for i, t in enumerate(texts)}
    assert got == want and any(want[i] != texts[i] for i in want)


def test_numbered_and_other_loops(spark):
    ten = "\n".join(f"{i}. Nộp hồ sơ tại cơ quan có thẩm quyền" for i in range(1, 11))
    five = "\n".join(f"{i}. Nộp hồ sơ tại cơ quan có thẩm quyền" for i in range(1, 6))
    money = "\n".join(f"{i}. Phạt tiền từ {i}.000.000 đồng đến mức cao hơn" for i in range(1, 11))
    run = "\n".join(f"{i}) {SENTENCE}" for i in range(1, 5))
    df = spark.createDataFrame(list(enumerate([ten, five, money, run, f"{SENTENCE}. " * 4, SENTENCE])), "i int, t string")
    out = loops.with_loops_removed(df, "t", loops.EXTENDED).select("i", "proposed", loops.loop_reasons(F.col("t"), F.col("changes")).alias("r"))
    got = {x.i: x for x in out.collect()}
    assert got[0].proposed == "1. Nộp hồ sơ tại cơ quan có thẩm quyền" and "numbered_loop" in got[0].r
    assert got[1].proposed == five and got[2].proposed == money and got[2].r == []
    assert got[3].r == ["runaway_incrementing_list"] and got[4].r == ["exact_adjacent_loop"] and got[5].r == []


def test_inline_loops_numbers_and_headings(one):
    phrase = "cơ quan có thẩm quyền"
    assert one(loops.inline_phrase_loop, f"{phrase}, " * 12, f"{phrase} " * 3, "1 2 3 " * 20, "một hai ba bốn năm sáu " * 4,
               "một hai ba bốn năm sáu " * 3) == [True, False, False, True, False]
    assert one(loops.long_numeric_run, ", ".join(map(str, range(10, 322))), ", ".join(map(str, range(10, 29))),
               " ".join(f"1.{i}" for i in range(40)), " ".join(map(str, range(0, 80, 2)))) == [True, False, False, False]
    assert one(loops.heading_only, "Điều 5. Thời hạn giải quyết", "Theo Nghị định, quy định như sau:", "1. Đơn đề nghị",
               "Người lao động được nghỉ 12 ngày.", "", "Hồ sơ:\nThủ tục cấp phép", "Hà Nội") == [True, True, False, False, False, True, False]


def plain_phrase_loop(words):
    for width in range(3, 25):
        needed = max(4, -(-24 // width))
        for at in range(len(words) - width * needed + 1):
            block = words[at:at + width]
            if words[at:at + width * needed] == block * needed and any(c.isalpha() for w in block for c in w):
                return True
    return False


def test_phrase_loops_of_every_width_and_place(one):
    r, cases = random.Random(5), []
    for width in range(2, 26):
        for copies in (max(4, -(-24 // width)), max(4, -(-24 // width)) - 1):
            for lead in r.sample(range(30), 4):
                block = [r.choice(["điều", "khoản", "7", "a", "b"]) + str(r.randint(0, 30)) for _ in range(width)]
                cases.append([f"trước{i}" for i in range(lead)] + block * copies + block[:r.randint(0, width - 1)] + [f"sau{i}" for i in range(r.randint(0, 9))])
    cases += [r.choices(["a", "b", "1"], k=r.randint(20, 90)) for _ in range(150)]
    got = one(loops.inline_phrase_loop, *[" ".join(c) for c in cases])
    want = [plain_phrase_loop(c) for c in cases]
    assert got == want and 50 < sum(want) < len(want) - 50


def test_screens_before_the_full_checks(one):
    sixteen = "Thời hạn " + " ".join(f"giờ{'x' * i}" for i in range(14))
    assert one(loops.heading_only, sixteen, sixteen + " thêm", f"{sixteen}\r\n\n \x85#", "x\u2028Điều 5. Hà Nội", "Điều 5. Hà Nội\x1c ",
               "字" * 50_000) == [True, False, True, False, True, False]
    assert one(loops.long_numeric_run, " ".join(map(str, range(999_980, 1_000_000))), ";\n".join(map(str, range(19))),
               "1234567 " + " ".join(map(str, range(20))), "7" * 100_000) == [True, False, True, False]
    again = "Nộp hồ sơ đầy đủ tại cơ quan có thẩm quyền trong thời hạn quy định của pháp luật"
    assert one(lambda c: loops.may_loop(c, RepairPolicy()), f" {again}. {again}.\n{again}.", f"{again}? {again}? {again}?",
               f"{again}\r{again}\n{again}", again, "") == [True, True, True, False, False]
    assert one(tx.lines, "a\r\nb\rc\r\r\nd\x0be\x85f\u2029g\n") == [["a", "b", "c", "", "d", "e", "f", "g", ""]]


def test_reasons_cut_lines_once(spark):
    reasons = loops.measurement_reasons(F.col("t"), F.col("c"))
    rows = spark.createDataFrame([(None, [])], f"t string, c {loops.RESULT['changes'].dataType.simpleString()}").select(reasons.alias("v"))
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1 and rows.first().v == []


def test_repetition_ratio_and_runs(spark, one):
    assert one(an.repetition_ratio, f"{SENTENCE}\n" * 4, SENTENCE, "ngắn") == [0.75, 0.0, 0.0]
    got = one(lambda c: loops.runs(F.split(c, ",")), "a,a,b,a")[0]
    assert [(r.start, r.length, r.value) for r in got] == [(1, 2, "a"), (3, 1, "b"), (4, 1, "a")]


CTX = "qid int, question string, context int, doc_id string, number string, heading string, text string"
QUESTION = "Hồ sơ hải quan nhập khẩu gồm những gì"


def test_support(spark):
    good = "Thành phần hồ sơ hải quan nhập khẩu gồm tờ khai và hóa đơn " + "x " * 30
    rows = [(1, QUESTION, 0, "d", "", "", "quy định chung về thuế"), (1, QUESTION, 1, "d", "", "", good),
            (2, QUESTION, 0, "d", "", "", "nội dung khác hẳn"), (3, QUESTION + " mới nhất", 0, "d", "", "", good),
            (4, "Người lao động nghỉ hưu bao nhiêu tuổi", 0, "d", "", "", "người lao động nghỉ hưu bao nhiêu tuổi theo luật"),
            (5, QUESTION, 0, "d", "", "", "")]
    got = {r.qid: r for r in ev.local_support(spark.createDataFrame(rows, CTX)).collect()}
    assert got[1].strong and got[1].context == 1 and got[1].coverage == 1.0
    assert not got[2].strong and not got[3].strong and not got[3].marker_ok
    assert not got[4].strong and not got[4].age_value_present
    assert got[5].context is None and not got[5].strong and got[5].question_terms == 7
    focus = ev.focused_contexts(spark.createDataFrame(rows, CTX), ev.local_support(spark.createDataFrame(rows, CTX)))
    assert sorted((r.qid, r.context) for r in focus.collect() if r.qid in (1, 5)) == [(1, 0), (1, 1), (5, 0)]


def test_conflict(spark):
    body = "ông Nguyễn Văn A giữ chức vụ chủ tịch hội đồng quản lý từ năm nay"
    rows = [(1, "Ai là chủ tịch?", 0, "a", "1795/QĐ-TTg", "", "quyết định về tổ chức bộ máy"), (1, "Ai là chủ tịch?", 1, "b", "435/QĐ-BNV", "", body)]
    answers = spark.createDataFrame([(1, "Ai là chủ tịch?", "Theo 1795/QĐ-TTg, " + body), (2, "Vì sao?", "Theo 1795/QĐ-TTg")], "qid int, question string, answer string")
    got = {r.qid: r for r in ev.citation_conflict(answers, spark.createDataFrame(rows, CTX)).collect()}
    assert got[1].conflict and got[1].conflicting_context_index == 1 and got[1].copied_phrase_words == 12
    assert not got[2].conflict


def test_fallback_quotes_the_window(spark):
    filler = " ".join(f"đệm{i}," for i in range(300))
    rows = [(1, QUESTION, 0, "d", "", "", "không liên quan gì cả"), (1, QUESTION, 1, "d", "9/QĐ", "Điều 1", filler + " hồ sơ hải quan nhập khẩu gồm tờ khai.")]
    c = spark.createDataFrame(rows, CTX)
    text = ev.extractive_fallback(c, ev.local_support(c), max_words=200).first().answer
    assert text.startswith("9/QĐ Điều 1\n") and text.endswith("tờ khai") and len(text.split()) <= 205
    short = spark.createDataFrame([(1, QUESTION, 0, "d", "", "", "hồ sơ")], CTX)
    assert ev.extractive_fallback(short, ev.local_support(short)).first().answer == tx.lx.NO_EVIDENCE


def test_same_document(spark):
    rows = spark.createDataFrame([(1, "q", i, d, "", "", "t") for i, d in enumerate("abaa")] + [(2, "q", i, d, "", "", "t") for i, d in enumerate(["", "x"])], CTX)
    got = sorted((r.qid, r.context) for r in ev.same_document(rows, 2, True).collect())
    assert got == [(1, 0), (1, 2), (2, 0), (2, 1)]


def test_policy_is_checked():
    with pytest.raises(ValueError):
        RepairPolicy(min_repeats=2)
