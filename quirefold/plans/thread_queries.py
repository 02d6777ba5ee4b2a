"""Queries on threads, edits, stores and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.functions import fixed as v
from quirefold.functions import tables as tb
from quirefold.functions import text as tx
from quirefold.operators import edits as ed
from quirefold.operators import export as ex
from quirefold.operators import threads as th
from quirefold.plans import inputs, sql
from quirefold.plans.registry import query
from quirefold.session import materialize, work_dir
from quirefold.sources import documents as src
from quirefold.sources import sinks

c = sql.compose
_J = lambda x: f"coalesce(array_to_string({x}, ','), '')"


def _join(col):
    return F.coalesce(F.array_join(col, ","), F.lit(""))


# --- stores and appended messages -------------------------------------------------------------------------------


def _stores(spark, sf):
    """Stores of several documents, every tenth conversation of one remainder a document line instead: a conversation is
    a document of a block per turn, and of its threads with their messages."""
    m = inputs.messages(spark, sf)
    doc = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    message = F.struct(F.concat(F.lit("m"), F.col("seq").cast("string")).alias("id"), "role", "content", F.col("created_at").cast("string").alias("createdAt"), F.col("cited").alias("citedParagraphIds"), "error", F.when(F.col("interrupted"), F.lit(True)).alias("interrupted"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("seq", c.alias("x")))), lambda s: s["x"])
    threads = m.groupBy("doc_id", "thread_key").agg(in_order(message).alias("messages"))
    threads = threads.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("thread_key", F.struct(F.col("thread_key").alias("paragraphId"), "messages").alias("t")))).alias("threads"))
    block = F.struct(F.concat(F.lit("p"), (F.col("seq") + 1).cast("string")).alias("id"), F.col("seq").alias("index"), F.lit("paragraph").alias("type"), F.col("content").alias("text"), F.when(F.col("seq") % 2 == 0, F.lit(True)).alias("rich"))
    blocks = m.groupBy("doc_id").agg(in_order(block).alias("paragraphs"), F.sum(F.length("content")).alias("size"))
    documents = blocks.join(threads, "doc_id").select("doc_id", doc.alias("key"), F.struct(doc.alias("id"), F.concat(F.lit("T "), doc).alias("title"), F.lit("text").alias("format"), "size", "paragraphs", "threads").alias("d"))
    store = documents.where("doc_id % 10 <> 3").groupBy((F.col("doc_id") % 7).alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("key", "d"))).alias("documents"))
    return store.select(F.to_json(F.struct(F.lit(1).alias("version"), "documents")).alias("value")).union(documents.where("doc_id % 10 = 3").select(F.to_json("d").alias("value")))


@query("S4_load_store_messages", c("messages", f"SELECT 'd' || doc_id AS doc_id, thread_key, row_number() OVER (PARTITION BY doc_id, thread_key ORDER BY seq) - 1 AS seq, 'm' || seq AS msg_id, role, content, {_J('cited')} AS cited, coalesce(error, '') AS error, interrupted FROM messages"))
def load_store_messages(spark, sf):
    m = src.load_store(_stores(spark, sf))["messages"]
    return m.select("doc_id", "thread_key", "seq", "msg_id", "role", "content", _join("cited").alias("cited"), F.coalesce("error", F.lit("")).alias("error"), "interrupted")


@query("S4_load_store_blocks", c("messages", "SELECT 'd' || doc_id AS doc_id, 'T d' || doc_id AS title, CAST(sum(length(content)) OVER (PARTITION BY doc_id) AS BIGINT) AS size, 'p' || (seq + 1) AS block_id, CAST(seq AS INTEGER) AS idx, content AS text, seq % 2 = 0 AS rich FROM messages"))
def load_store_blocks(spark, sf):
    """Written as a file of one store or document a line, and read back."""
    folder = work_dir(spark, "stores")
    _stores(spark, sf).write.text(folder)
    t = src.read_store(spark, folder, lines=True)
    return t["blocks"].join(t["documents"].select("doc_id", "title", "size"), "doc_id").select("doc_id", "title", "size", "block_id", "idx", "text", "rich")


@query("S6_append_messages", c("messages", """SELECT doc_id, thread_key, row_number() OVER (PARTITION BY doc_id, thread_key ORDER BY k, seq) - 1 AS seq, content FROM (
 SELECT *, 0 AS k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, thread_key ORDER BY seq) AS rn FROM messages) UNION ALL SELECT *, 1 AS k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, thread_key ORDER BY seq) AS rn FROM messages) WHERE role = 'user')"""))
def append_messages(spark, sf):
    m = inputs.messages(spark, sf)
    dense = th.ordered.scan(m, th.THREAD, ["seq"], before={"n": F.lit(1)}).withColumn("seq", F.col("n").cast("long")).drop("n")
    new = m.filter(F.col("role") == "user").withColumnRenamed("seq", "at")
    return th.append_messages(dense, new).select("doc_id", "thread_key", "seq", "content")


@query("S6_touch_documents", c("docs messages", "SELECT d.doc_id, greatest(d.updated_at, coalesce(max(m.created_at), 0)) AS updated_at FROM docs d LEFT JOIN messages m ON m.doc_id = d.doc_id GROUP BY d.doc_id, d.updated_at"))
def touch_documents(spark, sf):
    return th.touch_documents(inputs.doc_meta(spark, sf), inputs.messages(spark, sf)).select("doc_id", "updated_at")


# --- questions and answers --------------------------------------------------------------------------------------

_PAIR = f"SELECT doc_id, thread_key, seq, question, answer, error, created_at, {_J('cited')} AS cited FROM pairs"


@query("Q1_pair_messages", c("pairs", _PAIR))
def pair_messages(spark, sf):
    return th.pair_messages(inputs.messages(spark, sf)).withColumn("cited", _join("cited")).drop("qa_no")


@query("Q2_pair_messages_show_errors", c("pairs", "SELECT doc_id, thread_key, seq, question, CASE WHEN error <> '' THEN '［请求失败］' || error ELSE answer END AS answer FROM pairs"))
def pair_messages_errors(spark, sf):
    return th.pair_messages(inputs.messages(spark, sf), show_errors=True).select("doc_id", "thread_key", "seq", "question", "answer")


_ITEM = "doc_id, block_id, idx, type, text, coalesce(qa_no, -1) AS qa_no, coalesce(question, '') AS question, coalesce(answer, '') AS answer"


def _items(spark, sf, only):
    t = th.to_items(inputs.blocks(spark, sf), th.pair_messages(inputs.messages(spark, sf)), only)
    e = lambda x: F.coalesce(x, F.lit("")).alias(x)
    return t.select("doc_id", "block_id", "idx", "type", "text", F.coalesce("qa_no", F.lit(-1)).cast("long").alias("qa_no"), e("question"), e("answer"))


@query("Q3_to_items", c("items", f"SELECT {_ITEM} FROM items"))
def to_items(spark, sf):
    return _items(spark, sf, False)


@query("Q3_to_items_answered", c("items", f"SELECT {_ITEM} FROM items WHERE qa_no IS NOT NULL"))
def to_items_answered(spark, sf):
    return _items(spark, sf, True)


@query("Q4_count_questions", c("messages", "SELECT doc_id, count(*) FILTER (role = 'user') AS questions FROM messages GROUP BY doc_id"))
def count_questions(spark, sf):
    return th.count_questions(inputs.messages(spark, sf))


_LIST = """SELECT d.doc_id, d.title, d.filename, d.format, d.created_at, d.updated_at, coalesce(b.n, 0) AS blocks, coalesce(m.n, 0) AS questions, coalesce(m.t, 0) AS asked_threads, coalesce(r.quality = 1, false) AS refined, coalesce(r.doc_id % 7 * 1820, 0) AS refine_tokens FROM docs d LEFT JOIN labels r ON r.doc_id = d.doc_id
 LEFT JOIN (SELECT doc_id, count(*) AS n FROM blocks GROUP BY doc_id) b ON b.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, count(*) FILTER (role = 'user') AS n, count(DISTINCT thread_key) FILTER (role = 'user') AS t FROM messages GROUP BY doc_id) m ON m.doc_id = d.doc_id"""


def _listed(spark, sf):
    return th.list_documents(inputs.doc_meta(spark, sf), inputs.blocks(spark, sf), inputs.messages(spark, sf), inputs.refine_runs(spark, sf))


@query("Q5_list_documents", c("blocks messages", _LIST))
def list_documents(spark, sf):
    return _listed(spark, sf)


@query("Q18_recent_documents", c("blocks messages", f"SELECT * FROM ({_LIST}) ORDER BY updated_at DESC, doc_id LIMIT 4"))
def recent_documents(spark, sf):
    return th.recent_documents(_listed(spark, sf), 4)


@query("Q6_summarize", c("blocks items", """SELECT d.doc_id, coalesce(b.n, 0) AS blocks, coalesce(m.n, 0) AS questions, coalesce(a.n, 0) AS answered, d.pages FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n FROM blocks GROUP BY doc_id) b ON b.doc_id = d.doc_id
 LEFT JOIN (SELECT doc_id, count(*) FILTER (role = 'user') AS n FROM messages GROUP BY doc_id) m ON m.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, count(DISTINCT block_id) AS n FROM items WHERE qa_no IS NOT NULL GROUP BY doc_id) a ON a.doc_id = d.doc_id"""))
def summarize(spark, sf):
    m = inputs.messages(spark, sf)
    return th.summarize(inputs.doc_meta(spark, sf), inputs.blocks(spark, sf), th.pair_messages(m), m).select("doc_id", "blocks", "questions", "answered", "pages")


@query("Q7_answered_count", c("blocks messages", "SELECT doc_id, count(*) AS answered FROM blocks b WHERE EXISTS (SELECT 1 FROM messages m WHERE m.doc_id = b.doc_id AND m.thread_key = b.block_id AND m.role = 'user') GROUP BY doc_id"))
def answered_count(spark, sf):
    return th.answered_count(inputs.asked_blocks(spark, sf), inputs.messages(spark, sf))


def _cited(spark, sf):
    return inputs.messages(spark, sf).filter(F.col("cited").isNotNull())


for _style in ("export", "print"):

    @query(f"Q8_cite_label_{_style}", c("messages blocks", "SELECT doc_id, thread_key, seq, label FROM " + sql.cites("messages", "doc_id, thread_key, seq", "blocks", _style)))
    def cite_label(spark, sf, style=_style):
        return th.cite_labels(_cited(spark, sf), [*th.THREAD, "seq"], inputs.asked_blocks(spark, sf), style)


@query("Q9_carry_citations", c("messages", f"SELECT m.doc_id, m.thread_key, m.seq, {_J('CASE WHEN len(m.cited) > 0 THEN m.cited ELSE u.cited END')} AS carried FROM messages m LEFT JOIN messages u ON u.doc_id = m.doc_id AND u.thread_key = m.thread_key AND u.role = 'user' AND u.seq = (SELECT max(x.seq) FROM messages x WHERE x.doc_id = m.doc_id AND x.thread_key = m.thread_key AND x.role = 'user' AND x.seq < m.seq)"))
def carry_citations(spark, sf):
    return th.carry_citations(inputs.messages(spark, sf)).select("doc_id", "thread_key", "seq", _join("carried").alias("carried"))


@query("Q10_extract_citations", c("messages blocks", """SELECT m.doc_id, thread_key, seq, pos, n, coalesce(list_contains(included, b.block_id), false) AS valid FROM (
 SELECT *, 0 AS pos, 2 AS n FROM messages WHERE role = 'assistant' UNION ALL SELECT *, 1, 5 FROM messages WHERE role = 'assistant' UNION ALL SELECT *, 2, 999 FROM messages WHERE role = 'assistant') m LEFT JOIN blocks b ON b.doc_id = m.doc_id AND b.idx + 1 = m.n"""))
def extract_citations(spark, sf):
    marks = F.lit(" [第 2 段] `[第1段]` **[第1段]** $[第1段]$ [第5段]\n```\n[第1段]\n```\n见 [第999段] *[第3段]*")
    plain = F.translate("content", "`*_$[\\", "      ")
    a = inputs.messages(spark, sf).filter(F.col("role") == "assistant").withColumn("content", F.concat(plain, marks))
    return th.extract_citations(a, inputs.asked_blocks(spark, sf))


@query("Q11_attach_cross", c("pairs blocks", f"""SELECT p.doc_id, p.thread_key AS block_id, 'own' AS source, p.qa_no, p.question, p.answer FROM pairs p JOIN blocks b ON b.doc_id = p.doc_id AND b.block_id = p.thread_key
 UNION ALL SELECT f.doc_id, f.block_id, 'cross', p.qa_no, p.question, p.answer FROM (SELECT doc_id, unnest(cited) AS block_id FROM pairs WHERE thread_key = '{v.CROSS}' AND qa_no = 0) f JOIN blocks b ON b.doc_id = f.doc_id AND b.block_id = f.block_id
 JOIN pairs p ON p.doc_id = f.doc_id AND p.thread_key = '{v.CROSS}'"""))
def attach_cross(spark, sf):
    return th.attach_cross(inputs.asked_blocks(spark, sf), th.pair_messages(inputs.messages(spark, sf)))


@query("Q12_number_questions", c("numbered", "SELECT doc_id, block_id, qa_no, q_no, anchor, question FROM numbered"))
def number_questions(spark, sf):
    items = th.to_items(inputs.asked_blocks(spark, sf), th.pair_messages(inputs.messages(spark, sf)), True)
    return th.number_questions(items).select("doc_id", "block_id", "qa_no", "q_no", "anchor", "question")


@query("Q13_answer_messages", c("messages blocks", f"SELECT doc_id, thread_key, seq, length(content) AS chars FROM messages m WHERE role = 'assistant' AND content <> '' AND (thread_key = '{v.CROSS}' OR EXISTS (SELECT 1 FROM blocks b WHERE b.doc_id = m.doc_id AND b.block_id = m.thread_key))"))
def answer_messages(spark, sf):
    return th.answer_messages(inputs.messages(spark, sf), inputs.asked_blocks(spark, sf))


@query("Q14_delete_thread", c("messages", "SELECT doc_id, thread_key, seq FROM messages WHERE NOT (thread_key = 'p1' AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))"))
def delete_thread(spark, sf):
    keys = inputs.table(spark, sf, "labels").filter("toxic = 1").select("doc_id", F.lit("p1").alias("thread_key"))
    return th.delete_threads(inputs.messages(spark, sf), keys).select("doc_id", "thread_key", "seq")


@query("Q14_delete_document", c("blocks messages", "SELECT 'blocks' AS child, doc_id, count(*) AS n FROM blocks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY doc_id UNION ALL SELECT 'messages', doc_id, count(*) FROM messages WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY doc_id"))
def delete_document(spark, sf):
    keys = inputs.table(spark, sf, "labels").filter("quality = 0").select("doc_id")
    left = th.delete_documents({"blocks": inputs.blocks(spark, sf), "messages": inputs.messages(spark, sf)}, keys)
    parts = [t.groupBy("doc_id").agg(F.count("*").alias("n")).select(F.lit(k).alias("child"), "doc_id", "n") for k, t in left.items()]
    return parts[0].unionByName(parts[1])


@query("Q15_retain_newest", c("docs", "SELECT doc_id, updated_at FROM docs ORDER BY updated_at DESC, doc_id DESC LIMIT 200"))
def retain_newest(spark, sf):
    return th.retain_newest(inputs.doc_meta(spark, sf)).select("doc_id", "updated_at")


@query("Q16_public_view", c("docs", "SELECT doc_id, title, filename, format, size, created_at, updated_at, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS n_assets, doc_id % 2 = 0 AS has_local_backup, doc_id % 5 = 0 AS has_original_file FROM docs"))
def public_view(spark, sf):
    d = F.col("doc_id")
    full = inputs.doc_meta(spark, sf).withColumns({
        "assets": F.when(d % 3 == 0, F.array("filename")), "page_images": F.lit(None).cast("array<string>"), "backup": F.when(d % 2 == 0, F.lit("[]")), "file_path": F.when(d % 5 == 0, F.col("filename")),
    })
    return th.public_view(full).select("doc_id", "title", "filename", "format", "size", "created_at", "updated_at", F.size("assets").alias("n_assets"), "has_local_backup", "has_original_file")


@query("Q17_thread_lookup", c("docs messages", "SELECT d.doc_id, coalesce(m.seq, -1) AS seq, coalesce(m.role, '') AS role, coalesce(m.content, '') AS content, m.seq IS NOT NULL AS found FROM docs d LEFT JOIN messages m ON m.doc_id = d.doc_id AND m.thread_key = 'p1'"))
def thread_lookup(spark, sf):
    asks = inputs.doc_meta(spark, sf).select("doc_id", F.lit("p1").alias("thread_key"))
    return th.thread_lookup(asks, inputs.messages(spark, sf)).drop("thread_key")


@query("Q19_retry_question", c("messages", "SELECT doc_id, thread_key, seq, coalesce((SELECT max_by(u.content, u.seq) FROM messages u WHERE u.doc_id = m.doc_id AND u.thread_key = m.thread_key AND u.role = 'user' AND u.seq < m.seq), '') AS question FROM messages m WHERE role = 'assistant' AND error IS NOT NULL"))
def retry_question(spark, sf):
    return th.retry_questions(inputs.messages(spark, sf))


@query("Q20_rounds_per_thread", c("messages", "SELECT doc_id, thread_key, count(*) FILTER (role = 'user') AS asked FROM messages GROUP BY ALL"))
def rounds_per_thread(spark, sf):
    return th.rounds_per_thread(inputs.messages(spark, sf))


# --- edits ------------------------------------------------------------------------------------------------------

sql.CTES["edits"] = ([], """edits AS (SELECT conv_id AS doc_id, 'p' || (turn % 3 + 1) AS block_id, turn AS ts, CASE WHEN n % 9 = 0 THEN 'reset' ELSE 'set' END AS op, CASE n % 4 WHEN 0 THEN text WHEN 1 THEN '  $E = mc^2$ ' || text WHEN 2 THEN '  ' END AS text,
 CASE n % 5 WHEN 0 THEN ' x^2 ' WHEN 1 THEN '' END AS tex, CASE n % 6 WHEN 0 THEN 'heading' WHEN 1 THEN 'formula' WHEN 2 THEN 'table' END AS type FROM (SELECT *, length(text) AS n FROM conversations))""")
# Edits replayed one call at a time over the state of each block.
_TY = "CASE WHEN e.type IN ('paragraph', 'heading', 'list', 'formula') THEN e.type END"
sql.CTES["replayed"] = (["edits", "blocks"], f"""calls AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block_id ORDER BY ts) AS k, {sql.trim('text')} AS tt, {sql.trim('tex')} AS xx FROM edits),
replay AS (WITH RECURSIVE st AS (SELECT doc_id, block_id, CAST(0 AS BIGINT) AS k, type, text, CAST(NULL AS VARCHAR) AS tex, rich, false AS display, false AS edited, CAST(NULL AS BIGINT) AS edited_at, type AS type0, text AS text0, false AS saved, 'none' AS lastop FROM blocks
 UNION ALL SELECT s.doc_id, s.block_id, c.k,
 CASE WHEN c.op = 'reset' THEN s.type0 WHEN c.bad THEN s.type ELSE coalesce(c.ty, s.type) END, CASE WHEN c.op = 'reset' THEN s.text0 WHEN c.bad THEN s.text ELSE coalesce(c.tt, s.text) END, CASE WHEN c.op = 'reset' THEN NULL WHEN c.bad THEN s.tex ELSE coalesce(nullif(c.xx, ''), s.tex) END,
 CASE WHEN c.op = 'reset' OR c.bad OR c.tt IS NULL THEN s.rich ELSE {sql.has_math('c.tt')} END, CASE WHEN c.op = 'set' AND NOT c.bad AND c.ty = 'formula' THEN true ELSE s.display END,
 CASE WHEN c.op = 'reset' THEN false WHEN c.bad THEN s.edited ELSE s.edited OR c.tt IS NOT NULL OR c.xx IS NOT NULL OR c.ty IS NOT NULL END, CASE WHEN c.op = 'reset' THEN NULL WHEN c.bad THEN s.edited_at ELSE c.ts END, s.type0, s.text0, c.op = 'set', c.op
 FROM st s JOIN (SELECT e.*, coalesce(e.op = 'set' AND e.tt = '', false) AS bad, {_TY} AS ty FROM calls e) c ON c.doc_id = s.doc_id AND c.block_id = s.block_id AND c.k = s.k + 1)
 SELECT * FROM st),
replayed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, block_id ORDER BY k DESC) AS rn FROM replay) WHERE rn = 1)""")
_ED = "doc_id, block_id, type, text, coalesce(tex, '') AS tex, rich, display, edited, coalesce(edited_at, -1) AS edited_at"


def _plain_blocks(spark, sf):
    return inputs.blocks(spark, sf).withColumns({"tex": F.lit(None).cast("string"), "display": F.lit(False)})


def _flat(e):
    return e.select("doc_id", "block_id", "type", "text", F.coalesce("tex", F.lit("")).alias("tex"), "rich", "display", "edited", F.coalesce("edited_at", F.lit(-1)).cast("long").alias("edited_at"))


@query("E1_apply_edits", c("replayed", f"SELECT {_ED} FROM replayed"))
def apply_edits(spark, sf):
    return _flat(ed.apply_edits(_plain_blocks(spark, sf), inputs.edits(spark, sf)))


@query("E2_keep_originals", c("replayed", "SELECT doc_id, block_id, text0 AS text, type0 AS type FROM replayed WHERE saved"))
def keep_originals(spark, sf):
    return ed.keep_originals(_plain_blocks(spark, sf), inputs.edits(spark, sf)).select("doc_id", "block_id", "text", "type")


@query("E3_reset_blocks", c("replayed", f"SELECT {_ED} FROM replayed WHERE lastop = 'reset'"))
def reset_blocks(spark, sf):
    return _flat(ed.reset_blocks(_plain_blocks(spark, sf), inputs.edits(spark, sf)))


@query("E4_rename_documents", c("docs questions", "SELECT d.doc_id, CASE WHEN coalesce(q.t, '') = '' THEN d.title ELSE left(q.t, 200) END AS title FROM docs d LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE question END AS t FROM questions) q ON q.doc_id = d.doc_id"))
def rename_documents(spark, sf):
    t = inputs.questions(spark, sf).select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("question")).alias("new_title"))
    return ed.rename_documents(inputs.doc_meta(spark, sf), t).select("doc_id", "title")


@query("E5_reparse_version", c("docs", "SELECT doc_id, title, filename, CAST(-1 AS BIGINT) AS reparsed_from FROM docs UNION ALL SELECT doc_id + 1000000000, title || ' · 新版解析', filename, doc_id FROM docs WHERE doc_id IN (SELECT doc_id FROM labels)"))
def reparse_version(spark, sf):
    fresh = inputs.table(spark, sf, "labels").select((F.col("doc_id") + 1000000000).alias("doc_id"), F.col("doc_id").alias("reparsed_from"))
    return ed.reparse_versions(inputs.doc_meta(spark, sf), fresh).withColumn("reparsed_from", F.coalesce("reparsed_from", F.lit(-1)))


# --- exports ----------------------------------------------------------------------------------------------------


@query("S5_export_filename", c("docs", "SELECT doc_id, left(regexp_replace(t, '[\\\\/:*?\"<>|\\r\\n]+', '_', 'g'), 80) || '-问答记录.md' AS filename FROM (SELECT doc_id, replace(text, ' ', '?/') AS t FROM docs)"))
def export_filename(spark, sf):
    return inputs.docs(spark, sf).select("doc_id", sinks.export_filename(F.replace("text", F.lit(" "), F.lit("?/")), "md").alias("filename"))




@query("X1_table_markdown", f"""WITH r AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda r: string_split(r, ' ')) AS rows FROM documents),
p AS (SELECT doc_id, list_transform(rows, lambda r: '| ' || array_to_string(list_concat(list_transform(r, lambda q: replace(q, '|', '\\|')), list_transform(range(list_max(list_transform(rows, lambda z: len(z))) - len(r)), lambda i: '')), ' | ') || ' |') AS ls, '| ' || array_to_string(list_transform(range(list_max(list_transform(rows, lambda z: len(z)))), lambda i: '---'), ' | ') || ' |' AS rule FROM r)
SELECT doc_id, array_to_string(list_concat(list_concat([ls[1]], [rule]), ls[2:]), chr(10)) AS md FROM p""")
def table_markdown(spark, sf):
    rows = F.transform(F.split("text", "\n"), lambda r: F.split(r, " "))
    return inputs.documents(spark, sf).select("doc_id", rows.alias("rows")).select("doc_id", tb.table_markdown(F.col("rows")).alias("md"))


_MDROWS = "list_transform(rows, lambda r: '| ' || array_to_string(list_concat(list_transform(r, lambda q: regexp_replace(replace(q, '|', '\\|'), '\\n+', ' ', 'g')), list_transform(range(list_max(list_transform(rows, lambda z: len(z))) - len(r)), lambda i: '')), ' | ') || ' |')"
_MDRULE = "'| ' || array_to_string(list_transform(range(list_max(list_transform(rows, lambda z: len(z)))), lambda i: '---'), ' | ') || ' |'"
_BODY = f"CASE type WHEN 'table' THEN array_to_string(list_concat(list_concat(({_MDROWS})[1:1], [{_MDRULE}]), ({_MDROWS})[2:]), chr(10)) WHEN 'image' THEN '![插图 1](' || urls[1] || ')' ELSE text END"


@query("X2_block_markdown", c("typed", f"SELECT doc_id, idx, {_BODY} AS md FROM typed"))
def block_markdown(spark, sf):
    b = inputs.typed_blocks(spark, sf)
    return b.select("doc_id", "idx", ex.block_markdown(F.col("type"), F.col("text"), F.col("rows"), F.col("urls")).alias("md"))


N = "chr(10)"
sql.CTES["labelled"] = (["typed", "blocks", "numbered", "docs"], f"""lab AS (SELECT n.*, coalesce(l.label, '') AS cite FROM numbered n LEFT JOIN {sql.cites('numbered', 'doc_id, block_id, seq', 'blocks')} l ON l.doc_id = n.doc_id AND l.block_id = n.block_id AND l.seq = n.seq),
qa1 AS (SELECT doc_id, item_no, string_agg('**问' || CASE WHEN cite = '' THEN '' ELSE ' ' || cite END || '：** ' || question || {N}||{N} || '**答：**' || {N}||{N} || CASE WHEN answer = '' THEN '_（未获得回答）_' ELSE answer END || {N} || {N}, '' ORDER BY qa_no) AS t FROM lab GROUP BY ALL),
qa2 AS (SELECT doc_id, string_agg('**Q' || q_no || '**' || CASE WHEN type = 'cross' THEN '（跨段落）' ELSE '（段落 ' || (idx + 1) || '）' END || CASE WHEN cite = '' THEN '' ELSE ' ' || cite END || '：' || question || {N}||{N} || CASE WHEN answer = '' THEN '_（未获得回答）_' ELSE answer END || {N}, {N} ORDER BY q_no) AS t FROM lab GROUP BY doc_id),
its AS (SELECT doc_id, idx AS item_no, '### ' || CASE type WHEN 'table' THEN '表格' WHEN 'image' THEN '插图' WHEN 'formula' THEN '公式' ELSE '段落' END || ' ' || (idx + 1) || '（第 ' || page || ' 页）' || {N}||{N} || CASE WHEN type IN ('image', 'table') THEN {_BODY} ELSE '> ' || regexp_replace(text, '\\n+', ' ', 'g') END || {N} || {N} AS t FROM typed
 UNION ALL SELECT DISTINCT doc_id, item_no, '### 跨段落关联提问' || {N}||{N} || '> （跨段落关联提问）' || {N} || {N} FROM items WHERE type = 'cross'),
sec1 AS (SELECT i.doc_id, string_agg(i.t || coalesce(q.t, '') || '---' || {N}, {N} ORDER BY i.item_no) AS t FROM its i LEFT JOIN qa1 q ON q.doc_id = i.doc_id AND q.item_no = i.item_no GROUP BY i.doc_id),
summ AS (SELECT d.*, (SELECT count(*) FROM blocks b WHERE b.doc_id = d.doc_id) AS nb, (SELECT count(*) FROM messages m WHERE m.doc_id = d.doc_id AND role = 'user') AS nq FROM docs d)""")


def _export_inputs(spark, sf):
    return inputs.doc_meta(spark, sf), materialize(inputs.typed_blocks(spark, sf), "blocks"), inputs.messages(spark, sf)


_MD = f"""SELECT s.doc_id, '# ' || title || {N}||{N} || '> 来源文件：`' || filename || '` ｜ 段落：' || nb || CASE WHEN pages > 0 THEN ' ｜ 页数：' || pages ELSE '' END || ' ｜ 提问：' || nq || ' 条' || {N}||{N} || '---' || {N} || CASE WHEN q.t IS NULL THEN {N} || '_（暂无问答记录）_' || {N} ELSE '' END || {N}
 || '## 一、原文与问答（逐块）' || {N} || {N} || sec1.t || {N} || '## 二、问答记录清单' || {N} || CASE WHEN q.t IS NULL THEN {N} || '_（暂无问答记录）_' || {N} ELSE {N} || q.t END AS body FROM summ s LEFT JOIN sec1 ON sec1.doc_id = s.doc_id LEFT JOIN qa2 q ON q.doc_id = s.doc_id"""


@query("X3_build_markdown", c("labelled", _MD))
def build_markdown(spark, sf):
    return ex.build_markdown(*_export_inputs(spark, sf)).select("doc_id", "body")


_NAME = "left(regexp_replace(d.title, '[\\\\/:*?\"<>|\\r\\n]+', '_', 'g'), 80)"


@query("S5_write_markdown", c("labelled docs", f"SELECT d.doc_id, {_NAME} || '-问答记录.md' AS name, x.body FROM ({_MD}) x JOIN docs d ON d.doc_id = x.doc_id"))
def write_markdown(spark, sf):
    """Written as a file per document under its export name and read back."""
    out = work_dir(spark, "exports")
    docs, blocks, messages = _export_inputs(spark, sf)
    fragments = materialize(ex.markdown_fragments(docs, blocks, messages), "fragments")
    sinks.write_exports(fragments.join(docs.select("doc_id", "title"), "doc_id"), out)
    return sinks.read_exports(spark, out)


_FLAT = f"""SELECT d.doc_id, 'summary' AS part, CAST(-2 AS BIGINT) AS item, -1 AS qa, s.title || '|' || s.nb || '|' || s.nq AS content FROM docs d JOIN summ s ON s.doc_id = d.doc_id
 UNION ALL SELECT doc_id, 'item', item_no, -1, any_value(block_id || '|' || type || '|' || text) FROM (SELECT i.doc_id, i.block_id, coalesce(t.type, i.type) AS type, i.text, i.item_no FROM items i LEFT JOIN typed t ON t.doc_id = i.doc_id AND t.block_id = i.block_id) GROUP BY doc_id, item_no
 UNION ALL SELECT doc_id, 'qa', item_no, qa_no, question || '|' || answer || '|' || error || '|' || {_J('cited')} FROM numbered"""


def _flattened(body):
    """JSON bodies parsed back and flattened."""
    kind = "struct<document:struct<title:string,blocks:bigint,questions:bigint>,items:array<struct<paragraphId:string,type:string,text:string,qa:array<struct<question:string,answer:string,error:string,citedParagraphIds:array<string>>>>>>"
    j = body.select("doc_id", F.from_json("body", kind).alias("j"))
    e = lambda x: F.coalesce(x, F.lit(""))
    bar = lambda *cs: F.concat_ws("|", *cs)
    one = lambda part, item, qa, content: F.struct(F.lit(part).alias("part"), item.cast("long").alias("item"), qa.cast("long").alias("qa"), content.alias("content"))
    none = F.array().cast("array<struct<part:string,item:bigint,qa:bigint,content:string>>")
    each = lambda rows, row: F.coalesce(F.transform(rows, row), none)
    place = lambda i, pos: F.when(i["type"] == "cross", (1 << 31) - 1).otherwise(pos)
    item = lambda i, pos: one("item", place(i, pos), F.lit(-1), bar(i["paragraphId"], i["type"], i["text"]))
    qa = lambda i, pos: each(i["qa"], lambda q, n: one("qa", place(i, pos), n, bar(q["question"], e(q["answer"]), e(q["error"]), _join(q["citedParagraphIds"]))))
    summary = one("summary", F.lit(-2), F.lit(-1), bar("j.document.title", F.col("j.document.blocks").cast("string"), F.col("j.document.questions").cast("string")))
    # All rows of a body in one pass: bodies are made, or read, and parsed once.
    pairs = F.coalesce(F.flatten(F.transform("j.items", qa)), none)
    return j.select("doc_id", F.explode(F.concat(F.array(summary), each(F.col("j.items"), item), pairs)).alias("r")).select("doc_id", "r.*")


@query("X4_build_json", c("labelled", _FLAT))
def build_json(spark, sf):
    return _flattened(ex.build_json(*_export_inputs(spark, sf)))


@query("S5_write_json", c("labelled", _FLAT))
def write_json(spark, sf):
    """Written as a file per document under its export name and read back."""
    out = work_dir(spark, "exports")
    docs, blocks, messages = _export_inputs(spark, sf)
    fragments = materialize(ex.json_fragments(docs, blocks, messages), "fragments")
    sinks.write_exports(fragments, out, "json", "", titles=docs)
    return _flattened(sinks.read_exports(spark, out))


@query("X5_strip_math", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\$\\$([^$]+)\\$\\$', '\\1', 'g'), '\\$([^$]+)\\$', '\\1', 'g'), '\\n+', ' ', 'g') AS text FROM documents")
def strip_math(spark, sf):
    return inputs.documents(spark, sf).select("doc_id", tx.strip_math(F.col("text")).alias("text"))


@query("X6_print_view", c("numbered blocks", f"SELECT n.doc_id, n.q_no, n.block_id, coalesce(l.label, '') AS cited, n.question, CASE WHEN n.error <> '' THEN '［请求失败］' || n.error ELSE n.answer END AS answer FROM numbered n LEFT JOIN {sql.cites('numbered', 'doc_id, block_id, seq', 'blocks', 'print')} l ON l.doc_id = n.doc_id AND l.block_id = n.block_id AND l.seq = n.seq"))
def print_view(spark, sf):
    return ex.print_view(inputs.asked_blocks(spark, sf), inputs.messages(spark, sf))


@query("X7_fit_image", """SELECT doc_id, least(w, CAST(520 AS DOUBLE)) AS width, CASE WHEN w > 520 THEN greatest(CAST(1 AS DOUBLE), floor(h * (CAST(520 AS DOUBLE) / w) + CAST(0.5 AS DOUBLE))) ELSE h END AS height FROM (
 SELECT doc_id, w, CASE WHEN h0 = 0 THEN CAST(320 AS DOUBLE) WHEN h0 < 0 THEN floor(w * CAST(0.7 AS DOUBLE) + CAST(0.5 AS DOUBLE)) ELSE CAST(h0 AS DOUBLE) END AS h FROM (SELECT doc_id, CASE WHEN n_chars % 1000 - 100 > 0 THEN CAST(n_chars % 1000 - 100 AS DOUBLE) ELSE CAST(460 AS DOUBLE) END AS w, doc_id % 700 - 50 AS h0 FROM documents))""")
def fit_image(spark, sf):
    f = tb.fit_image(F.col("n_chars") % 1000 - 100, F.col("doc_id") % 700 - 50)
    return inputs.table(spark, sf, "documents").select("doc_id", f.alias("f")).select("doc_id", "f.width", "f.height")
