"""Inputs of the registered queries, derived by Spark from the given tables (whole tables, whole texts).

documents become study documents (blank lines, section titles and list lines added, so that blocks vary);
conversations become threads on them; every derived row comes from a table row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import fixed as v
from quirefold.operators import blocks as bl
from quirefold.operators import context as cx
from quirefold.operators import refine as rf
from quirefold.session import materialize


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "source", "n_chars")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to tasks: a table may lie in few row groups, and each is read by one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def docs(spark, sf) -> DataFrame:
    """Study documents."""
    s = F.replace(F.replace("text", F.lit(". "), F.lit("。 ")), F.lit(".\n"), F.lit("。\n"))
    section = F.concat(F.lit("Abstract\n"), F.replace(s, F.lit("\n"), F.lit("\n\n2.1 Section\n- point one\n")))
    third = F.col("doc_id") % 3
    text = F.when(third == 0, s).when(third == 1, F.replace(s, F.lit("\n"), F.lit("\n\n"))).otherwise(section)
    d = spread(documents(spark, sf))
    return d.select(
        "doc_id", text.alias("text"), *_meta(), F.col("n_chars").alias("size"),
    )


def _meta():
    title = F.concat(F.lit("Study "), F.col("doc_id").cast("string"), F.lit(" "), "source")
    return [
        title.alias("title"),
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.when(F.col("doc_id") % 4 == 0, "pdf").otherwise("text").alias("format"),
        F.when(F.col("doc_id") % 4 == 0, (F.floor(F.col("n_chars") / 2000) + 1).cast("int")).alias("pages"),
        (F.col("doc_id") * 60 + 1700000000).alias("created_at"),
        (F.col("doc_id") * 60 + 1700000000 + F.col("doc_id") * 7919 % 100000).alias("updated_at"),
    ]


def doc_meta(spark, sf) -> DataFrame:
    """Study documents without their text (the scan reads no text column)."""
    return table(spark, sf, "documents").select("doc_id", *_meta(), F.col("n_chars").alias("size"))


def blocks(spark, sf) -> DataFrame:
    return bl.segment_documents(docs(spark, sf))


def asked_documents(spark, sf) -> DataFrame:
    """The study documents with a thread, for questions on them; cut down before any text work."""
    keys = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    return docs(spark, sf).join(keys, "doc_id", "left_semi")


def asked_blocks(spark, sf) -> DataFrame:
    return bl.segment_documents(asked_documents(spark, sf))


def typed(b: DataFrame) -> DataFrame:
    """Blocks with tables (bars), formulas (inline math), images (by length), pages, levels, rows and urls."""
    kind = (
        F.when(F.contains("text", F.lit(" | ")), "table")
        .when(F.contains("text", F.lit("$")), "formula")
        .when(F.length("text") % 13 == 0, "image")
        .otherwise(F.col("type"))
    )
    out = b.withColumn("type", kind).withColumn("page", F.floor(F.col("idx") / 5).cast("int") + 1)
    rows = F.transform(F.split("text", "。 "), lambda r: F.split(r, r" \| "))
    return (
        out.withColumn("level", F.when(F.col("type") == "heading", (F.length("text") % 4 + 1).cast("int")))
        .withColumn("rows", F.when(F.col("type") == "table", rows))
        .withColumn("urls", F.when(F.col("type") == "image", F.array(F.concat(F.lit("img/"), "block_id", F.lit(".png")))))
    )


def typed_blocks(spark, sf) -> DataFrame:
    return typed(blocks(spark, sf))


def cited_by_length():
    third = F.length("text") % 3
    return F.when(third == 1, F.array(F.lit("p2"))).when(third == 2, F.array(F.lit("p3"), F.lit("p1"), F.lit("p9999")))


def messages(spark, sf) -> DataFrame:
    key = F.when(F.col("conv_id") % 5 == 4, v.CROSS).when(F.col("turn") >= 4, "p2").otherwise("p1")
    bot = F.col("role") == "assistant"
    n = F.length("text")
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), key.alias("thread_key"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"),
        F.when(bot & (n % 7 == 0), "timeout").alias("error"), (bot & (n % 11 == 0)).alias("interrupted"),
        F.when(F.col("role") == "user", cited_by_length()).alias("cited"),
        F.when(bot, F.array(F.lit("p1"), F.lit("p2"))).alias("included"),
        (F.col("conv_id") * 100 + F.col("turn") + 1700100000).alias("created_at"),
    )


def questions(spark, sf) -> DataFrame:
    """The last user turn of every conversation as a question on the document of the same number."""
    conv = table(spark, sf, "conversations").filter(F.col("role") == "user")
    last = conv.groupBy("conv_id").agg(F.max_by(F.struct("turn", "text"), "turn").alias("m")).select("conv_id", "m.turn", "m.text")
    c = F.col("conv_id")
    return last.select(
        c.alias("q_id"), c.alias("doc_id"), "turn",
        F.when(c % 10 == 7, v.CROSS).when(c % 10 == 9, "p9999").otherwise("p1").alias("block_id"),
        F.col("text").alias("question"), cited_by_length().alias("cited"),
        F.when(c % 4 == 2, "neighbors").when(c % 4 == 3, "paragraph").otherwise("full").alias("mode"),
        (c % 6 * 700 + 2000).alias("budget"),
        F.expr("repeat('请简洁回答。', cast(1 + conv_id % 200 as int))").alias("system_prompt"),
    )


def history(spark, sf) -> DataFrame:
    """Messages before each question."""
    q = questions(spark, sf).select("q_id", "turn")
    m = messages(spark, sf).select(F.col("doc_id").alias("q_id"), "seq", "role", "content", "error", "interrupted")
    return m.join(q, "q_id").filter(F.col("seq") < F.col("turn")).drop("turn")


def prepared(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Prepared questions and the blocks of their documents, both written once: every later step reads them."""
    b = materialize(asked_blocks(spark, sf), "blocks")
    return materialize(cx.prepare(questions(spark, sf), history(spark, sf), b), "questions"), b


def packed(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    p, b = prepared(spark, sf)
    candidates = materialize(cx.candidate_order(p, b), "candidates")
    return p, b, cx.pack_context(p, candidates, b)


def edits(spark, sf) -> DataFrame:
    """Edit calls on the first blocks of documents: every conversation turn edits a block of its document."""
    t = F.col("turn")
    n = F.length("text")
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.concat(F.lit("p"), (t % 3 + 1).cast("string")).alias("block_id"), t.alias("ts"),
        F.when(n % 9 == 0, "reset").otherwise("set").alias("op"),
        F.when(n % 4 == 0, F.col("text")).when(n % 4 == 1, F.concat(F.lit("  $E = mc^2$ "), "text")).when(n % 4 == 2, F.lit("  ")).alias("text"),
        F.when(n % 5 == 0, F.lit(" x^2 ")).when(n % 5 == 1, F.lit("")).alias("tex"),
        F.when(n % 6 == 0, "heading").when(n % 6 == 1, "formula").when(n % 6 == 2, "table").alias("type"),
    )


def refine_lines(spark, sf) -> DataFrame:
    return rf.refine_lines(typed_blocks(spark, sf))


def refine_runs(spark, sf) -> DataFrame:
    """Refinement logs of the labelled documents: a first run that was off, a second one by the label."""
    d = F.col("doc_id")
    run = lambda at, on, tokens: F.struct(F.lit(at).alias("at"), on.alias("enabled"), tokens.cast("long").alias("total_tokens"))
    runs = F.array(run(2, F.col("quality") == 1, d % 7 * 1820), run(1, F.lit(False), d * 0 + 5))
    return table(spark, sf, "labels").select("doc_id", F.explode(runs).alias("r")).select("doc_id", "r.*")


def answer_items(b: DataFrame) -> DataFrame:
    """One model answer item per batched block: doc_id, batch, idx, item (struct), dropped for some blocks."""
    idx = F.col("idx")
    item = F.struct(
        idx.alias("n"),
        F.when(idx % 5 == 0, "formula").when(idx % 5 == 1, "table").when(idx % 5 == 2, "other").otherwise("paragraph").alias("type"),
        F.concat(F.lit(" fixed "), F.col("text"), F.when(idx % 2 == 0, " $x$").otherwise("")).alias("text"),
        F.when(idx % 5 == 0, F.lit("$$a_1+b$$")).alias("tex"),
        F.when(idx % 5 == 1, F.array(F.array(F.lit("h1"), F.lit("h2")), F.array(F.col("text")))).alias("rows"),
    )
    return b.select("doc_id", "batch", "idx", item.alias("item"))


def refine_responses(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Recorded answers for the refinement batches of all documents: responses, batches, blocks."""
    b = materialize(typed_blocks(spark, sf), "blocks")
    # Several steps meet the batches; they are three numbers a block.
    batches = materialize(rf.chunk_by_budget(rf.refine_lines(b)), "batches")
    items = answer_items(batches.join(b.select("doc_id", "idx", "text"), ["doc_id", "idx"]))
    bodies = items.groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(F.struct("idx", "item"))).alias("i")).select(
        "doc_id", "batch", F.to_json(F.struct(F.transform("i", lambda x: x["item"]).alias("blocks"))).alias("json")
    )
    usage = lambda k: F.struct(*[F.lit(n * k).cast("long").alias(c) for n, c in ((1200, "prompt_tokens"), (620, "completion_tokens"), (1820, "total_tokens"))])
    broken = (F.col("doc_id") + F.col("batch")) % 4
    tries = F.array(
        F.struct(F.lit(0).alias("attempt"), F.when(broken >= 2, F.lit("sorry {not json")).otherwise(F.concat(F.lit("```json\n"), "json", F.lit("\n```"))).alias("content"), usage(1).alias("usage"), F.lit("m-1").alias("model")),
        F.struct(F.lit(1).alias("attempt"), F.when(broken == 3, F.lit("no answer")).otherwise(F.concat(F.lit("Here: "), "json", F.lit(" done"))).alias("content"), usage(2).alias("usage"), F.lit("m-2").alias("model")),
    )
    tried = bodies.select("doc_id", "batch", F.explode(F.when(broken >= 2, tries).otherwise(F.slice(tries, 1, 1))).alias("t")).select("doc_id", "batch", "t.*")
    return tried, batches, b


def deltas(spark, sf) -> DataFrame:
    """Assistant turns cut into 18-character pieces, one event line each, on the wire: req_id, seq, chunk. The wire cuts
    every line behind its tenth character, so no chunk ends with a line, and the last line stays open."""
    text = table(spark, sf, "conversations").filter(F.col("role") == "assistant").select((F.col("conv_id") * 1000 + F.col("turn")).alias("req_id"), "text")
    n = F.ceil(F.length("text") / 18).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr("text", i * 18 + 1, F.lit(18)))
    event = lambda c: F.concat(F.lit('data: {"choices":[{"delta":{"content":'), c, F.lit("}}]}"))
    json = F.transform(pieces, lambda p: event(_quoted(p)))
    last = F.when(F.col("req_id") % 5 == 0, F.array(F.lit(": keep-alive"))).otherwise(
        F.array(
            F.concat(F.lit('data: {"model":"m-1","choices":[{"delta":{},"finish_reason":"'), F.when(F.col("req_id") % 5 == 1, "length").otherwise("stop"), F.lit('"}],"usage":{"prompt_tokens":10,"completion_tokens":5,"total_tokens":15}}')),
            F.lit("data: {broken"),
            F.lit("data: [DONE]"),
        )
    )
    lines = text.select("req_id", F.concat(F.when(F.length("text") > 0, json).otherwise(F.array().cast("array<string>")), last).alias("l"))
    rest = lambda i: F.substr(F.get("l", i), F.lit(11), F.lit(1 << 30))
    chunks = F.transform("l", lambda x, i: F.concat(F.when(i > 0, F.concat(rest(i - 1), F.lit("\n"))).otherwise(""), F.left(x, F.lit(10))))
    return lines.select("req_id", F.posexplode(F.concat(chunks, F.array(rest(F.size("l") - 1)))).alias("seq", "chunk")).withColumn("seq", F.col("seq").cast("long"))


def _quoted(c):
    arr = F.to_json(F.array(c))
    return F.substr(arr, F.lit(2), F.length(arr) - 2)


def requests(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").filter(F.col("role") == "assistant").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("req_id"), F.col("conv_id").alias("doc_id"), F.lit("p1").alias("thread_key"), F.col("turn").alias("at"), (F.col("conv_id") % 2 == 0).alias("aborted")
    )


def _words(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w", "str")).filter(F.col("str") != "")


PAGE_WORDS = 400


def _page_words(d: DataFrame) -> DataFrame:
    """The words of _words with their pages, dealt by page: the words of a page travel as one text, with the empty words
    that keep their places."""
    ws = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / PAGE_WORDS).cast("int")), lambda i: F.array_join(F.slice("ws", i * PAGE_WORDS + 1, F.lit(PAGE_WORDS)), " "))
    cut = d.select("doc_id", ws.alias("ws")).filter(F.col("ws").isNotNull()).select("doc_id", F.posexplode(pages).alias("p", "span"))
    dealt = cut.select("doc_id", (F.col("p") + 1).alias("page"), "span").repartition("doc_id", "page")
    words = dealt.select("doc_id", "page", F.posexplode(F.split("span", " ")).alias("k", "str")).filter(F.col("str") != "")
    return words.select("doc_id", "page", ((F.col("page") - 1) * PAGE_WORDS + F.col("k")).alias("w"), "str")


def _placed(words: DataFrame) -> DataFrame:
    w = F.col("w")
    r, k = F.floor(w % PAGE_WORDS / 10), w % 10
    dual = F.col("doc_id") % 2 == 0
    wide = dual & (r % 10 == 9) & (k == 0)
    x = F.when(wide, 250).when(dual & (k >= 5), 330 + (k - 5) * 50).otherwise(40 + k * 50).cast("double")
    shake = F.when(F.col("doc_id") % 3 == 0, (k % 4) * 1.5).otherwise((k % 3) * 1.0)
    return words.select(
        "doc_id", "page", w.cast("long").alias("item_no"), "str", x.alias("x"), F.when(wide, 100.0).otherwise(40.0).alias("w"),
        (780 - r * 15 + shake).cast("double").alias("y"), F.when(r == 0, 16.0).when(F.length("str") > 9, 9.0).otherwise(12.0).alias("h"),
        F.when(r == 0, "Serif-Bold").otherwise("Serif").alias("font"), F.lit(600.0).alias("page_width"),
    )


def items(spark, sf) -> DataFrame:
    """Every word of every document placed on pages of 40 rows: two columns on even documents, shaking base lines, some
    small words, a large first row, now and then an item across the gutter."""
    return _placed(_words(documents(spark, sf)).withColumn("page", (F.floor(F.col("w") / PAGE_WORDS) + 1).cast("int")))


def page_items(spark, sf) -> DataFrame:
    """The rows of items, dealt to tasks by page, for steps that work page by page: texts of pages are shuffled, not items."""
    return _placed(_page_words(documents(spark, sf)))


def parts(spark, sf) -> DataFrame:
    return page_items(spark, sf).withColumn("x0", F.col("x")).withColumn("x1", F.col("x") + F.col("w"))


def lines(spark, sf) -> DataFrame:
    """Every eight words of every document as a page line (45 to a page), with formula lines, leaders, indents, bold
    lines, table rows (some with split base lines) and broken words."""
    # Eight words travel as one text, with the empty words that keep their places.
    all_words = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    spans = F.transform(F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / 8).cast("int")), lambda i: F.array_join(F.slice("ws", i * 8 + 1, F.lit(8)), " "))
    cut = documents(spark, sf).select("doc_id", all_words.alias("ws")).filter(F.col("ws").isNotNull()).select("doc_id", F.posexplode(spans).alias("line_no", "span"))
    words = F.filter(F.flatten(F.transform("spans", lambda s: F.transform(F.split(s, " "), lambda w, i: F.struct(i.alias("w"), w.alias("str"))))), lambda x: x["str"] != "")
    # Dealt by page, as all that follows works page by page.
    dealt = cut.select("doc_id", (F.floor(F.col("line_no") / 45) + 1).cast("int").alias("page"), F.col("line_no").cast("long").alias("line_no"), "span").repartition("doc_id", "page")
    line = (
        dealt.groupBy("doc_id", "page", "line_no").agg(F.collect_list("span").alias("spans"))
        .select("doc_id", "page", "line_no", F.transform(F.array_sort(words), lambda x: x["str"]).alias("ws"))
        .filter(F.size("ws") > 0)
    )
    n = F.col("line_no")
    ln = n % 45
    raw = F.array_join("ws", " ")
    grid = ln.between(26, 33)
    math = ~grid & (n % 13 == 5)
    text = (
        F.when(math, F.concat(F.lit("a = b + "), n.cast("string")))
        .when(~grid & (n % 13 == 6), F.lit("x = y"))
        .when(~grid & (n % 13 == 4), F.lit("where E = mc"))
        .when(~grid & (n % 17 == 8), F.concat(raw, F.lit(" ..... 12")))
        .when(~grid & (n % 5 == 1), F.concat(raw, F.lit("-")))
        .otherwise(raw)
    )
    word = lambda i: F.coalesce(F.get("ws", F.lit(i)), F.lit("-"))
    cell = lambda x, t: F.struct(F.lit(float(x)).alias("x"), F.lit(float(x + 60)).alias("x1"), t.alias("text"))
    third = F.when(ln > 26, n.cast("string")).otherwise(word(2))
    table = F.when(ln == 30, F.array(cell(40, word(0)), cell(200, word(1)))).when(ln == 31, F.array(cell(360, third))).otherwise(F.array(cell(40, word(0)), cell(200, word(1)), cell(360, third)))
    x0 = F.when(~grid & (ln % 7 == 3), 54.0).otherwise(40.0)
    whole = F.array(F.struct(x0.alias("x"), F.lit(540.0).alias("x1"), text.alias("text")))
    return line.select(
        "doc_id", "page", "line_no", text.alias("text"), x0.alias("x0"), F.lit(540.0).alias("x1"),
        (780 - ln * 15 - F.floor(ln / 6) * F.when(grid, 0).otherwise(10) + F.when(ln == 31, 10).otherwise(0)).cast("double").alias("y"),
        F.when(~grid & (ln % 15 == 14), 15.0).otherwise(12.0).alias("h"), (~grid & (ln % 11 == 10)).alias("bold"), math.alias("is_math"),
        F.when(F.col("doc_id") % 2 == 0, F.when(ln < 22, "0").otherwise("1")).alias("col"), F.when(grid, table).otherwise(whole).alias("cells"),
        F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"),
    )


def images(spark, sf) -> DataFrame:
    """Images of study documents from their line lengths: sizes, repeats and heights vary."""
    d = documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("image_no", "line"))
    n = F.length("line")
    return d.select(
        "doc_id", (F.floor(F.col("image_no") / 6) + 1).cast("int").alias("page"), F.col("image_no").cast("long").alias("image_no"), F.concat(F.lit("k"), (n % 50).cast("string")).alias("key"),
        (n % 300).cast("int").alias("width"), (n % 170 + 20).cast("int").alias("height"), (n * 37 % 800).cast("double").alias("y"),
    )


def page_blocks(spark, sf) -> DataFrame:
    """Study blocks placed on pages of six, mostly downwards."""
    b = blocks(spark, sf)
    i = F.col("idx")
    return b.select("doc_id", (F.floor(i / 6) + 1).cast("int").alias("page"), i.cast("long").alias("pos"), (800 - i % 6 * 130 + F.length("text") % 200).cast("double").alias("y"), "type", "text")
