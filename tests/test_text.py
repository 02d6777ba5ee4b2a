"""Text rules on fixtures the driver tables lack: CJK, bullets, numbered lists, double marks, name repair."""

from pyspark.sql import functions as F

from quirefold.functions import tables as tb
from quirefold.functions import text as tx
from quirefold.functions import tokens as tk
from quirefold.operators.blocks import segment_documents
from quirefold.sources import documents as src


def one(spark, fn, *values):
    df = spark.createDataFrame([(x,) for x in values], "x string")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def blocks(spark, text, mode="txt"):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r["type"], r["text"]) for r in segment_documents(df, mode).orderBy("idx").collect()]


def test_sections(spark):
    got = blocks(spark, "一种方法的研究\n\n摘要\n\n本文介绍方法。\n\n1. 引言\n\n背景段落，说明问题。\n\n结论：方法有效。\n\n第二段。")
    assert len(got) >= 5 and ("heading", "摘要") in got and ("heading", "1. 引言") in got


def test_long_text_is_cut(spark):
    got = blocks(spark, "这是一个很长的句子，用来测试切分逻辑。" * 120)
    assert len(got) > 1 and all(len(t) <= 900 for _, t in got)
    assert "".join(t for _, t in got) == "这是一个很长的句子，用来测试切分逻辑。" * 120


def test_lists_and_headings(spark):
    assert blocks(spark, "1. X\n1) X\n1) x\n- X\n• X") == [("heading", "1. X"), ("heading", "1) X"), ("list", "1) x"), ("list", "- X"), ("list", "• X")]
    assert [k for k, _ in blocks(spark, "摘要\n介绍研究背景。\n1. 方法\n验证结论需要引用依据。")] == ["heading", "paragraph", "heading", "paragraph"]


def test_adjacent_marks_lose_the_second(spark):
    text = ("真的吗？！" + "好" * 400) * 4
    (parts,) = one(spark, tx.split_long, text)
    assert "！" not in "".join(parts) and "？" in "".join(parts)
    assert one(spark, tx.split_long, "？" * 1300) == [["？" * 1300]]


def test_paragraphs_break_only_when_long_enough(spark):
    short, long = "短句。", "长" * 61 + "。"
    assert blocks(spark, f"{short}\n{long}\n新段") == [("paragraph", short + long), ("paragraph", "新段")]
    assert blocks(spark, "ends here.\nNext line") == [("paragraph", "ends here. Next line")]
    assert blocks(spark, "a" * 70 + "!\nNext") == [("paragraph", "a" * 70 + "!"), ("paragraph", "Next")]
    # The newline before a Han character counts nothing: 58 + 2 = 60 is not yet long enough.
    assert len(blocks(spark, "b" * 57 + "!\n汉!\n汉c")) == 1
    assert len(blocks(spark, "b" * 58 + "!\n汉!\n汉c")) == 2


def test_pdf_mode(spark):
    assert blocks(spark, "a line\nnext part\n中文\n继续。\n新的", "pdf") == [("paragraph", "a line next part中文 继续。新的")]


def test_normalize(spark):
    assert one(spark, tx.normalize_whitespace, "a\r\nb\rc 　d\t\x0be  \n\n\n\nf") == ["a\nb\nc de\n\nf".replace("c de", "c d e")]


def test_names(spark):
    good = "RobustBench_中文精读总结.docx"
    bad = good.encode("utf8").decode("latin-1")
    assert one(spark, tx.fix_filename, bad, good, "paper.pdf", "", "报告 2024.pdf", "café.txt") == [good, good, "paper.pdf", "", "报告 2024.pdf", "café.txt"]
    assert one(spark, tx.safe_name, "a/b:*c\r\nd", "") == ["a_b_c_d", "document"]


def test_tokens_and_fit(spark):
    assert one(spark, tk.estimate_tokens, "", "abc", "中文", "，。a") == [0, 5, 6, 6]
    text = "验证abc" * 50

    def cost(t):
        han = sum(0x3400 <= ord(c) <= 0x4DBF or 0x4E00 <= ord(c) <= 0x9FFF or 0x3000 <= ord(c) <= 0x303F or 0xFF00 <= ord(c) <= 0xFFEF for c in t)
        import math

        return math.ceil(han * 0.75 + (len(t) - han) * 0.3) + 4

    suffix = "……（内容因长度限制节选）"
    for limit in (5, 20, 37, 60, 1000):
        (got,) = one(spark, lambda c: tk.fit_text(c, F.lit(limit)), text)
        fits = [n for n in range(len(text) + 1) if cost(text[:n] + suffix) <= limit]
        assert got == (text if cost(text) <= limit else text[: max(fits, default=0)] + suffix)


def test_tables(spark):
    df = spark.createDataFrame([([["数据集", "F1"], ["a|b\nc"], ["x", "1", "2"]],)], "rows array<array<string>>")
    r = df.select(tb.normalize_table(F.col("rows")), tb.table_markdown(F.col("rows")), tb.table_text(F.col("rows"))).first()
    assert r[0] == [["数据集", "F1", ""], ["a|b c", "", ""], ["x", "1", "2"]]
    assert r[1].split("\n") == ["| 数据集 | F1 |  |", "| --- | --- | --- |", "| a\\|b c |  |  |", "| x | 1 | 2 |"]
    assert r[2].startswith("［表格 3 行 × 3 列］\n数据集 | F1 | ")
    s = spark.createDataFrame([(["a", "b"], [2, 1])], "c array<string>, n array<int>").select(tb.expand_spans(F.col("c"), F.col("n"))).first()[0]
    assert s == ["a", "", "b"]


def test_formats(spark):
    rows = [("a.docx", "", "x"), ("a.pdf", "", "x"), ("a.doc", "", "x"), ("a.md", "", "x\x01"), ("a.bin", "", "x"), ("a.bin", "", "x\x01"), ("a", "text/html", "\x01")]
    df = spark.createDataFrame(rows, "n string, m string, h string")
    assert [r[0] for r in df.select(src.classify_format(F.col("n"), F.col("m"), F.col("h"))).collect()] == ["docx", "pdf", "reject", "text", "text", "reject", "text"]
