import hashlib
import json
import re
import unicodedata

from pyspark.sql import functions as F

from quillsift.functions import lexicon as lx, text as tx

SAMPLES = ["Điều 12a. Phạt _tiền_ 1.000.000 đồng", "STRASSE straße ß", "a½ Ⅻ x_y", "", "    một hai \t ba ",
           "Câu hỏi là gì và ở đâu", "été 가"]


def test_tokens_equal_the_unicode_rule(one):
    want = [re.findall(r"[^\W_]+", s.casefold()) for s in SAMPLES[:6]]
    assert one(tx.tokens, *SAMPLES[:6]) == want


def test_content_terms(one):
    terms = one(lambda c: tx.content_terms(tx.tokens(c)), "Người lao động là ai và người sử dụng có gì x")
    assert terms == [["người", "lao", "động", "sử", "dụng"]]


def test_words_strip_and_nfc(one):
    assert one(tx.word_count, *SAMPLES) == [len(s.split()) for s in SAMPLES]
    assert one(tx.strip, *SAMPLES) == [s.strip() for s in SAMPLES]
    assert one(tx.nfc, *SAMPLES) == [unicodedata.normalize("NFC", s) for s in SAMPLES]


def test_group_key(one):
    keys = one(tx.group_key, "  CÂU  HỎI 0? ", "câu hỏi 0", "phạt 10 triệu?", "phạt 100 triệu?")
    assert keys[0] == keys[1] == "câu hỏi 0" and keys[2] != keys[3]


def test_years_and_numbers(one):
    assert one(tx.document_year, "năm 2019 và 2023, 12020, 19999", "không") == [2023, None]
    got = one(tx.document_numbers, "06/2023/TT-BVHTTDL, 5868/QĐ-BYT ngày 01/08/2022")[0]
    assert got == ["06/2023/tt-bvhttdl", "5868/qđ-byt"]


def test_clean_document(one):
    assert one(tx.clean_document, " a\t\tb\r\n\n \n\n\nc ") == ["a b\n\nc"]


def test_long_lines(one):
    text = "x" * 35 + "\r\n  " + "y" * 34 + "\x85" + "z" * 40 + " "
    assert one(tx.long_lines, text) == [["x" * 35, "z" * 40]]


def test_digests(spark):
    row = spark.range(1).select(
        tx.digest(2026, F.concat(F.lit("["), tx.json_text(F.lit('a"é')), F.lit("]"))).alias("l"),
        tx.digest_object(id=tx.json_text(F.lit("7")), seed=2026).alias("o")).first()
    dump = lambda v: hashlib.sha256(json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert row.l == dump([2026, ['a"é']]) and row.o == dump({"seed": 2026, "id": "7"})


def test_ngrams(one):
    assert one(lambda c: tx.ngrams(tx.tokens(c), 3), "a b c d", "a b") == [["a b c", "b c d"], []]
    assert one(lambda c: tx.loaded_ngrams(tx.tokens(c), 3), "là của mức phạt") == [["của mức phạt"]]
    assert len(set(lx.STOP_WORDS)) == 30


def test_long_repeats_do_not_exhaust_the_stack(one):
    from quillsift.functions import loops
    assert one(tx.clean_document, "a" + "\n \t" * 100_000 + "\nb") == ["a\n\nb"]
    assert one(loops.long_numeric_run, ", ".join(map(str, range(1, 100_000))), ",;" * 100_000, "1 2 3") == [True, False, False]


def test_lines_end_once_at_carriage_return_line_feed(one):
    from quillsift.functions import loops
    assert one(tx.lines, "a\r\nb\rc\nd") == [["a", "b", "c", "d"]]
    body = "the same long body of an item that is repeated under other numbers again and again"
    for end in ("\n", "\r\n"):
        assert one(loops.runaway_list, end.join(f"{i}. {body}" for i in range(10 ** 20, 10 ** 20 + 6))) == [True]
