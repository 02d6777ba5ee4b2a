"""Packing against a plain walk, for random budgets and costs, and on the worked example."""

import math
import random

from pyspark.sql import functions as F

from quirefold.operators import context as cx
from quirefold.operators.refine import chunk_by_budget
from quirefold.operators import refine as rf


def test_relevant_late_block_is_kept(spark):
    texts = ["无关的背景资料。" * 20] * 79 + ["最重要的验证结论：香蕉模型在外部验证中失败。"]
    b = spark.createDataFrame([(1, f"p{i + 1}", i, "paragraph", t) for i, t in enumerate(texts)], "doc_id long, block_id string, idx int, type string, text string")
    ask = lambda q, block, cited: (q, 1, block, "香蕉模型的外部验证结果是什么？", cited, "full", 2000, "请简洁回答。")
    q = spark.createDataFrame([ask(1, "p1", []), ask(2, "__cross__", []), ask(3, "p999", [])], "q_id long, doc_id long, block_id string, question string, cited array<string>, mode string, budget int, system_prompt string")
    m = spark.createDataFrame([(1, 0, "user", "成功", None, False), (1, 1, "assistant", "好", None, False), (1, 2, "user", "失败", None, False), (1, 3, "assistant", "", "bad", False)], "q_id long, seq long, role string, content string, error string, interrupted boolean")
    p = cx.prepare(q, m, b)
    errors = {r["q_id"]: r["error"] for r in p.select("q_id", "error").collect()}
    assert errors[1] is None and errors[2] == "请至少选择一个引用段落" and errors[3] == "指定的段落不存在"
    docs = spark.createDataFrame([(1, "t", "text")], "doc_id long, title string, format string")
    out = cx.assemble_context(p, docs, b, cx.pack_context(p, cx.candidate_order(p, b), b)).collect()
    (r,) = out
    ids = r["included_ids"].split(",")
    assert r["truncated"] and r["context_tokens"] <= 2000 and "p1" in ids and "p80" in ids and r["error"] is None
    assert [x["content"] for x in r["messages"][2:4]] == ["成功", "好"]


def test_first_fit_bound_is_exact(spark):
    """Taking only the first floor(room / cost) of each cost changes nothing against walking every candidate."""
    rnd = random.Random(3)
    rows, want = [], {}
    for q in range(12):
        room = rnd.randint(60, 400)
        texts = ["字" * rnd.choice([1, 3, 10, 40, 90]) for _ in range(120)]
        left, taken = room, []
        for i, t in enumerate(texts):
            label = f"[第{i + 1}段]"
            cjk, other = 2 + len(t), len(label) - 2 + 1
            cost = math.ceil(cjk * 0.75 + other * 0.3) + 4 + 8
            if cost <= left:
                left -= cost
                taken.append(i)
            rows.append((q, f"p{i + 1}", i, "paragraph", t))
        want[q] = (room, taken)
    b = spark.createDataFrame(rows, "doc_id long, block_id string, idx int, type string, text string")
    q = spark.createDataFrame([(k, k, r) for k, (r, _) in want.items()], "q_id long, doc_id long, available long").withColumns({"n_required": F.lit(0), "target_idx": F.lit(None).cast("int")})
    c = b.select(F.col("doc_id").alias("q_id"), "doc_id", "idx", F.struct(F.lit(4).alias("tier"), F.lit(0.0).alias("weight"), F.col("idx").alias("at"), F.lit(0).alias("sub")).alias("place"))
    got = {}
    for r in cx.pack_context(q, c, b).collect():
        got.setdefault(r["q_id"], []).append(r["idx"])
    assert {k: sorted(x) for k, x in got.items()} == {k: t for k, (_, t) in want.items() if t}


def test_batches_do_not_depend_on_chunks(spark):
    rnd = random.Random(5)
    lines = [(d, i * 2, "词" * rnd.choice([10, 300, 2000, 8000])) for d in range(4) for i in range(150)]
    df = spark.createDataFrame(lines, "doc_id long, idx int, line string")
    want = []
    for d in range(4):
        tokens = n = batch = 0
        for _, i, t in [x for x in lines if x[0] == d]:
            c = math.ceil(len(t) * 0.75) + 4 + 8
            if n and (tokens + c > 5200 or n >= 28):
                batch, tokens, n = batch + 1, 0, 0
            tokens, n = tokens + c, n + 1
            want.append((d, i, batch))
    for size in (30, 64, 2048):
        assert sorted(tuple(r) for r in chunk_by_budget(df, size).collect()) == want


def test_loose_json(spark):
    cases = ['{"a":1}', '```json\n{"a":1}\n```', 'Sure: {"a":1} done', "none"]
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert [r[0] for r in df.select(rf.loose_json(F.col("c"))).collect()] == ['{"a":1}'] * 3 + ["none"]
