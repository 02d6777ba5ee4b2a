"""Chunked scans equal plain windows, also for a group that holds most rows; assembly gives one value at every size."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.operators import ordered, refine
from quirefold.streaming import answers


def rows(n=400):
    rnd = random.Random(7)
    seqs = rnd.sample(range(5 * n), n)
    return [("hot" if i % 3 else f"k{i % 17}", s, rnd.choice([None, "a", "b"]), rnd.randint(0, 9)) for i, s in enumerate(seqs)]


def test_scan_equals_windows(spark):
    df = spark.createDataFrame(rows(), "k string, seq long, v string, n long")
    got = ordered.scan(
        df, ["k"], ["seq"], ordered.chunk_of("seq", 7),
        lead={"nx": F.struct("v")}, lag={"pv": F.col("n")}, last={"ls": F.col("v")}, before={"bf": F.col("n")}, total={"tt": F.col("n")},
    )
    w = W.partitionBy("k").orderBy("seq")
    b = w.rowsBetween(W.unboundedPreceding, -1)
    want = df.select(
        "*", F.lead(F.struct("v")).over(w).alias("nx"), F.lag("n").over(w).alias("pv"), F.last("v", ignorenulls=True).over(b).alias("ls"),
        F.coalesce(F.sum("n").over(b), F.lit(0)).alias("bf"), F.sum("n").over(W.partitionBy("k")).alias("tt"),
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_prefix_maps_compose_in_order(spark):
    rnd = random.Random(3)
    rows = [(k, i, [rnd.choice([None, 0, 1, 2, 3]) if rnd.random() < 0.1 else rnd.randrange(4) for _ in range(4)]) for k, n in (("a", 37), ("b", 1), ("c", 8)) for i in range(n)]
    want, state = {}, {}
    for k, i, m in rows:
        state[k] = [m[x] if x is not None else None for x in state.get(k, range(4))]
        want[k, i] = state[k]
    got = ordered.prefix_maps(spark.createDataFrame(rows, "k string, i long, m array<bigint>"), ["k"], "i", "m")
    assert {(r["k"], r["i"]): r["m"] for r in got.collect()} == want


def test_batches_over_many_chunks_are_those_of_one(spark):
    rnd = random.Random(11)
    lines = spark.createDataFrame([(d, i, "x" * rnd.choice([5, 300, 4000, 17_000])) for d, n in ((1, 400), (2, 3)) for i in range(n)], "doc_id long, idx int, line string")
    rows = lambda size: sorted(map(tuple, refine.chunk_by_budget(lines, size).collect()))
    assert rows(32) == rows(2048) and max(b for _, _, b in rows(32)) > 30


def test_assemble_joins_in_order(spark):
    df = spark.createDataFrame([("a", i, f"x{i}") for i in (3, 1, 2)] + [("b", 1, "y")], "d string, n long, t string")
    assert sorted(map(tuple, ordered.assemble(df, ["d"], ["n"], "t", "-").collect())) == [("a", "x1-x2-x3"), ("b", "y")]


def test_large_values_have_the_form_of_small_ones(spark):
    """18 million characters: one prompt with its outline, one message, one body."""
    big = F.repeat(F.lit("x"), F.lit(9_000_000))
    two = spark.createDataFrame([(1, i, f"p{i + 1}", "heading") for i in range(2)], "doc_id long, idx int, block_id string, type string").withColumn("text", big)
    lines = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id long, idx int, line string")
    batches = spark.createDataFrame([(1, 0, 0), (1, 1, 0)], "doc_id long, idx int, batch int")
    docs = spark.createDataFrame([(1, "t")], "doc_id long, title string")
    (r,) = refine.refine_prompts(docs, two, lines, batches).select("batch", "n_blocks", F.length("prompt").alias("n")).collect()
    assert (r["batch"], r["n_blocks"]) == (0, 2) and r["n"] > 18_000_000
    parts = two.select(F.col("doc_id").alias("req_id"), F.col("idx").cast("long").alias("part"), F.col("text").alias("content"), F.lit("").alias("reasoning"), F.lit("stop").alias("finish_reason"), F.lit("m").alias("model"), F.lit(None).cast("string").alias("usage"))
    requests = spark.createDataFrame([(1, 1, "p1", 0, False)], "req_id long, doc_id long, thread_key string, at int, aborted boolean")
    (m,) = answers.persist_answers(answers.classify_outcome(answers.join_parts(parts)), requests).select(F.length("content").alias("n")).collect()
    assert m["n"] == 18_000_000
    (b,) = ordered.assemble(two, ["doc_id"], ["idx"], "text", "\n").select(F.length("text").alias("n"), F.substr("text", F.lit(9_000_001), F.lit(1)).alias("sep")).collect()
    assert (b["n"], b["sep"]) == (18_000_001, "\n")


def test_scan_gives_the_largest_value_before(spark):
    df = spark.createDataFrame(rows(), "k string, seq long, v string, n long")
    got = ordered.scan(df, ["k"], ["seq"], ordered.chunk_of("seq", 7), top={"tp": F.col("n")})
    want = df.select("*", F.max("n").over(W.partitionBy("k").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)).alias("tp"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_answers_are_parsed_once(spark, monkeypatch):
    """The JSON text of an answer and its blocks are each found once a row, whatever is filtered by them."""
    rows = [(1, 0, 0, "no"), (1, 0, 1, '```json\n{"blocks":[{"n":"1","text":"a"}]}\n```'), (1, 0, 2, 'Here {"blocks":[{"n":"2"}]} done'), (1, 1, 0, '{"blocks":[]}'), (2, 0, 0, None), (2, 1, 0, "{}")]
    responses = spark.createDataFrame(rows, "doc_id long, batch int, attempt int, content string")
    best = refine.first_valid(responses)
    assert sorted((r["doc_id"], r["batch"], r["attempt"], r["json"]) for r in best.collect()) == [(1, 0, 1, '{"blocks":[{"n":"1","text":"a"}]}'), (1, 1, 0, '{"blocks":[]}'), (2, 1, 0, "{}")]
    found = refine.parsed(best)
    assert [(r["doc_id"], r["batch"], [b["text"] for b in r["blocks"]]) for r in found.collect()] == [(1, 0, ["a"])]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f"{name}(") for name in ("from_json", "parseJson", "regexp_extract")] == [1, 1, 1], plan
