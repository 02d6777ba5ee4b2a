"""Questions, answers and citations over messages(doc_id, thread_key, seq, role, content, error, ..)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.functions import fixed as v
from quirefold.functions.text import fill, trim
from quirefold.operators import ordered
from quirefold.session import materialize

THREAD = ["doc_id", "thread_key"]


def pair_messages(messages: DataFrame, show_errors: bool = False) -> DataFrame:
    """Each user message with the answer right after it ('' when there is none): doc_id, thread_key, seq, question,
    answer, error, created_at, cited, and qa_no, its dense position in the thread. An orphan answer is dropped."""
    talk = messages.filter(F.col("role").isin("user", "assistant"))
    asked = F.when(F.col("role") == "user", 1).otherwise(0).cast("long")
    paired = ordered.scan(talk, THREAD, ["seq"], lead={"a": F.struct("role", "content", "error")}, before={"qa_no": asked})
    answered = F.col("a.role") == "assistant"
    error = F.when(answered, F.coalesce("a.error", F.lit(""))).otherwise("")
    answer = F.when(answered, F.coalesce("a.content", F.lit(""))).otherwise("")
    if show_errors:
        answer = F.when(error != "", F.concat(F.lit(v.REQUEST_FAILED), error)).otherwise(answer)
    return paired.filter(F.col("role") == "user").select(
        *THREAD, "seq", F.col("content").alias("question"), answer.alias("answer"), error.alias("error"), "created_at", "cited", F.col("qa_no").cast("long").alias("qa_no")
    )


def to_items(blocks: DataFrame, pairs: DataFrame, only_answered: bool = False) -> DataFrame:
    """One row per (item, pair): every block (or only answered ones), then the cross item with idx -1.

    Rows stay flat, so a long thread is never one array. item_no puts the cross item after all blocks.
    """
    qa = pairs.select("doc_id", F.col("thread_key").alias("block_id"), "seq", "qa_no", "question", "answer", "error", "cited")
    page = F.col("page") if "page" in blocks.columns else F.lit(None).cast("int")
    b = blocks.select("doc_id", "block_id", "idx", "type", "text", page.alias("page"), F.col("idx").cast("long").alias("item_no"))
    own = b.join(qa, ["doc_id", "block_id"], "inner" if only_answered else "left")
    docs = blocks.select("doc_id").distinct()
    cross = (
        qa.filter(F.col("block_id") == v.CROSS)
        .join(docs, "doc_id", "left_semi")
        .select(
            "doc_id", "block_id", F.lit(-1).alias("idx"), F.lit("cross").alias("type"), F.lit(v.CROSS_TEXT).alias("text"),
            F.lit(None).cast("int").alias("page"), F.lit((1 << 31) - 1).cast("long").alias("item_no"),
            "seq", "qa_no", "question", "answer", "error", "cited",
        )
    )
    return own.unionByName(cross)


def count_questions(messages: DataFrame) -> DataFrame:
    return messages.groupBy("doc_id").agg(F.count_if(F.col("role") == "user").alias("questions"))


def rounds_per_thread(messages: DataFrame) -> DataFrame:
    return messages.groupBy(*THREAD).agg(F.count_if(F.col("role") == "user").alias("asked"))


def asked_threads(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("role") == "user").select(*THREAD).distinct()


def list_documents(docs: DataFrame, blocks: DataFrame, messages: DataFrame, refine_runs: DataFrame | None = None) -> DataFrame:
    """One row per document with its counts, newest update first; asked threads include the cross thread."""
    nb = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"))
    asked = asked_threads(messages).groupBy("doc_id").agg(F.count("*").alias("asked_threads"))
    out = docs.select("doc_id", "title", "filename", "format", "created_at", "updated_at")
    for t in (nb, count_questions(messages), asked):
        out = out.join(t, "doc_id", "left")
    if refine_runs is not None:
        runs = refine_runs.groupBy("doc_id").agg(F.max_by(F.struct("enabled", "total_tokens"), "at").alias("r"))
        out = out.join(runs, "doc_id", "left").withColumn("refined", F.coalesce("r.enabled", F.lit(False))).withColumn("refine_tokens", F.coalesce("r.total_tokens", F.lit(0))).drop("r")
    counts = ["blocks", "questions", "asked_threads"]
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts}).orderBy(F.desc("updated_at"), "doc_id")


def recent_documents(listed: DataFrame, n: int = 4) -> DataFrame:
    return listed.orderBy(F.desc("updated_at"), "doc_id").limit(n)


def summarize(docs: DataFrame, blocks: DataFrame, pairs: DataFrame, messages: DataFrame) -> DataFrame:
    """Blocks, questions and answered items (the cross item counts) per document."""
    nb = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"))
    threads = pairs.select("doc_id", F.col("thread_key").alias("block_id")).distinct()
    keys = blocks.select("doc_id", "block_id")
    answered = (
        threads.join(keys, ["doc_id", "block_id"], "left_semi")
        .unionByName(threads.filter(F.col("block_id") == v.CROSS))
        .groupBy("doc_id")
        .agg(F.count("*").alias("answered"))
    )
    out = docs
    for t in (nb, count_questions(messages), answered):
        out = out.join(t, "doc_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("blocks", "questions", "answered")})


def answered_count(blocks: DataFrame, messages: DataFrame) -> DataFrame:
    """Blocks with a question per document, without the cross thread."""
    asked = asked_threads(messages).select("doc_id", F.col("thread_key").alias("block_id"))
    hit = blocks.select("doc_id", "block_id").join(asked, ["doc_id", "block_id"], "left_semi")
    return hit.groupBy("doc_id").agg(F.count("*").alias("answered"))


def cite_labels(rows: DataFrame, keys: list[str], blocks: DataFrame, style: str = "export") -> DataFrame:
    """rows(keys, doc_id, cited array) -> keys, label. Unknown ids show as they are; the label is as long as its row."""
    known = blocks.select("doc_id", F.col("block_id").alias("id"), "idx")
    n = F.col("idx") + 1
    if style == "export":
        text, sep = F.when(F.col("idx").isNotNull(), fill(v.CITE_EXPORT, n)).otherwise(fill(v.CITE_EXPORT_UNKNOWN, F.col("id"))), " "
    else:
        text, sep = F.when(F.col("idx").isNotNull(), fill(v.CITE_PRINT, n)).otherwise(F.col("id")), v.CITE_PRINT_SEP
    return (
        rows.select(*keys, *([] if "doc_id" in keys else ["doc_id"]), F.posexplode("cited").alias("pos", "id"))
        .join(known, ["doc_id", "id"], "left")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))).alias("c"))
        .select(*keys, F.array_join(F.transform("c", lambda x: x["t"]), sep).alias("label"))
    )


def carry_citations(messages: DataFrame) -> DataFrame:
    """Adds carried: own cited ids, else those of the nearest earlier user message (possibly none)."""
    none = F.array().cast("array<string>")
    asked = F.when(F.col("role") == "user", F.struct(F.coalesce("cited", none).alias("c")))
    carried = ordered.scan(messages, THREAD, ["seq"], last={"near": asked})
    own = F.size(F.coalesce("cited", none)) > 0
    return carried.withColumn("carried", F.when(own, F.col("cited")).otherwise(F.coalesce("near.c", none))).drop("near")


def extract_citations(answers: DataFrame, blocks: DataFrame) -> DataFrame:
    """answers(doc_id, thread_key, seq, content, included array): cited block numbers in plain text, with valid."""
    plain = F.coalesce("content", F.lit(""))
    for p in v.HIDDEN_SPANS:
        plain = F.regexp_replace(plain, p, " ")
    found = answers.select(*THREAD, "seq", "included", F.posexplode(F.regexp_extract_all(plain, F.lit(v.CITATION), F.lit(1))).alias("pos", "d"))
    n = F.coalesce(F.expr("try_cast(d as int)"), F.lit(0))
    known = blocks.select("doc_id", (F.col("idx") + 1).alias("n"), "block_id")
    return (
        found.withColumn("n", n)
        .join(known, ["doc_id", "n"], "left")
        .select(*THREAD, "seq", "pos", "n", F.coalesce(F.array_contains("included", F.col("block_id")), F.lit(False)).alias("valid"))
    )


def attach_cross(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, block_id, source own/cross, qa_no, question, answer: a block's own pairs, and every pair of the cross
    item on each block cited by the first cross pair."""
    ids = blocks.select("doc_id", "block_id")
    own = pairs.withColumnRenamed("thread_key", "block_id").join(ids, ["doc_id", "block_id"], "left_semi").select("doc_id", "block_id", F.lit("own").alias("source"), "qa_no", "question", "answer")
    cross = pairs.filter(F.col("thread_key") == v.CROSS)
    cited = cross.filter(F.col("qa_no") == 0).select("doc_id", F.explode("cited").alias("block_id")).join(ids, ["doc_id", "block_id"], "left_semi")
    shared = cited.join(cross.select("doc_id", "qa_no", "question", "answer"), "doc_id").select("doc_id", "block_id", F.lit("cross").alias("source"), "qa_no", "question", "answer")
    return own.unionByName(shared)


def number_questions(items: DataFrame) -> DataFrame:
    """Adds q_no (1.. per document in item order, then pair order) and anchor (dense 0.. over items with pairs, -1 for
    the cross item). Takes answered to_items rows."""
    qa = materialize(items.filter(F.col("qa_no").isNotNull()), "answered")
    counts = qa.groupBy("doc_id", "item_no").agg(F.count("*").alias("n"))
    starts = ordered.scan(counts, ["doc_id"], ["item_no"], before={"start": F.col("n"), "anchor": F.lit(1)}).drop("n")
    anchor = F.when(F.col("type") == "cross", -1).otherwise(F.col("anchor"))
    return (
        qa.join(starts, ["doc_id", "item_no"])
        .withColumn("q_no", (F.col("start") + F.col("qa_no") + 1).cast("long"))
        .withColumn("anchor", anchor.cast("long"))
        .drop("start")
    )


def answer_messages(messages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Assistant messages with content on block threads and the cross thread, with their length."""
    keys = blocks.select("doc_id", F.col("block_id").alias("thread_key"))
    docs = blocks.select("doc_id").distinct()
    good = messages.filter((F.col("role") == "assistant") & (F.coalesce("content", F.lit("")) != ""))
    on_block = good.join(keys, THREAD, "left_semi")
    on_cross = good.filter(F.col("thread_key") == v.CROSS).join(docs, "doc_id", "left_semi")
    return on_block.unionByName(on_cross).select(*THREAD, "seq", F.length("content").cast("long").alias("chars"))


def delete_threads(messages: DataFrame, keys: DataFrame) -> DataFrame:
    return messages.join(keys, THREAD, "left_anti")


def delete_documents(tables: dict[str, DataFrame], keys: DataFrame) -> dict[str, DataFrame]:
    """The same deletion over every table that holds doc_id."""
    return {name: t.join(keys, "doc_id", "left_anti") for name, t in tables.items()}


def retain_newest(docs: DataFrame, n: int = v.DOCUMENTS_KEPT) -> DataFrame:
    return docs.orderBy(F.desc(F.coalesce("updated_at", "created_at")), F.desc("doc_id")).limit(n)


def public_view(docs: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return docs.select(
        "doc_id", "title", "filename", "format", "size", "created_at", "updated_at",
        F.coalesce("assets", none).alias("assets"),
        F.coalesce("page_images", none).alias("page_images"),
        F.col("backup").isNotNull().alias("has_local_backup"),
        F.col("file_path").isNotNull().alias("has_original_file"),
    )


def thread_lookup(asks: DataFrame, messages: DataFrame) -> DataFrame:
    """asks(doc_id, thread_key): the messages of each thread in order, or one row with found = false."""
    m = messages.select(*THREAD, "seq", "role", "content")
    return asks.join(m, THREAD, "left").select(
        *THREAD, F.coalesce("seq", F.lit(-1)).cast("long").alias("seq"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("content", F.lit("")).alias("content"), F.col("seq").isNotNull().alias("found"),
    )


def retry_questions(messages: DataFrame) -> DataFrame:
    """For each failed answer the nearest earlier question of its thread, '' if there is none."""
    near = ordered.scan(messages, THREAD, ["seq"], last={"retry": F.when(F.col("role") == "user", F.struct("content"))})
    failed = (F.col("role") == "assistant") & (F.coalesce("error", F.lit("")) != "")
    return near.filter(failed).select(*THREAD, "seq", F.coalesce("retry.content", F.lit("")).alias("question"))


def number_messages(heads: DataFrame, new: DataFrame) -> DataFrame:
    """New messages (with an arrival order `at`) with seq, counted on from the largest of their thread in
    heads(doc_id, thread_key, seq)."""
    last = heads.groupBy(*THREAD).agg(F.max("seq").alias("_last"))
    numbered = ordered.scan(new, THREAD, ["at"], before={"_n": F.lit(1)}).join(last, THREAD, "left")
    seq = (F.coalesce(F.col("_last"), F.lit(-1)) + 1 + F.col("_n")).cast("long")
    return numbered.withColumn("seq", seq).drop("_last", "_n", "at")


def append_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """Messages and new ones (with an arrival order `at`) numbered after the last one of their thread."""
    return messages.unionByName(number_messages(messages, new), allowMissingColumns=True)


def touch_documents(docs: DataFrame, messages: DataFrame) -> DataFrame:
    """updated_at moved to the newest message of each document."""
    newest = messages.groupBy("doc_id").agg(F.max("created_at").alias("_newest"))
    return docs.join(newest, "doc_id", "left").withColumn("updated_at", F.greatest("updated_at", "_newest")).drop("_newest")
