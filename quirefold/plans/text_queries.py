"""Queries on texts and blocks: sources, normalising, segmentation, token costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.functions import fixed as v
from quirefold.functions import tables as tb
from quirefold.functions import text as tx
from quirefold.functions import tokens as tk
from quirefold.operators import blocks as bl
from quirefold.plans import inputs, sql
from quirefold.plans.registry import query
from quirefold.session import work_dir
from quirefold.sources import documents as src
from quirefold.sources import sinks

NAMES = ".docx .pdf .doc .md .bin .TXT .json .zip".split()


def _uploads(spark, sf):
    d = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (d % len(NAMES) + 1).cast("int"))
    head = F.when(d % 16 == 4, F.concat(F.lit("\x01"), "text")).otherwise(F.col("text"))
    mime = F.when(d % 11 == 0, "text/plain").when(d % 13 == 0, v.PDF_MIME).otherwise("")
    return inputs.documents(spark, sf).select("doc_id", F.concat("source", F.lit("-"), d.cast("string"), ext).alias("filename"), mime.alias("mime"), head.alias("text"), F.when(d % 3 == 0, F.lit(" \n")).when(d % 3 == 1, F.col("text")).alias("pasted"), F.col("n_chars").alias("size"))


_UP = f"""WITH up AS (SELECT doc_id, source || '-' || doc_id || ([{', '.join(sql.s(n) for n in NAMES)}])[doc_id % 8 + 1] AS filename, CASE WHEN doc_id % 11 = 0 THEN 'text/plain' WHEN doc_id % 13 = 0 THEN 'application/pdf' ELSE '' END AS mime,
 CASE WHEN doc_id % 16 = 4 THEN chr(1) || text ELSE text END AS text, CASE doc_id % 3 WHEN 0 THEN ' ' || chr(10) WHEN 1 THEN text END AS pasted, n_chars AS size FROM documents),
u AS (SELECT *, lower(regexp_extract(filename, '[^/](\\.[^./]*)$', 1)) AS ext FROM up) """


@query("S1_read_documents", _UP + f"""SELECT doc_id, CASE WHEN p THEN 'paste' ELSE 'text' END AS format, length(t) AS chars, t AS text FROM (SELECT doc_id, p, CASE WHEN p THEN pasted ELSE text END AS t FROM (SELECT *, {sql.trim("coalesce(pasted, '')")} <> '' AS p FROM u))""")
def read_documents(spark, sf):
    return src.read_documents(_uploads(spark, sf))


@query("S1_read_text_files", "SELECT doc_id, 'text' AS format, octet_length(encode(text)) AS size, length(text) AS chars, text FROM documents")
def read_text_files(spark, sf):
    """Every text written as a file and read from the files."""
    folder = work_dir(spark, "texts")
    sinks.write_files(inputs.documents(spark, sf).select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").alias("body")), folder)
    files = src.read_text_files(spark, folder)
    number = F.regexp_extract("path", r"(\d+)\.txt\z", 1).cast("long")
    read = src.read_documents(files.select(number.alias("doc_id"), F.lit(None).cast("string").alias("pasted"), "text"))
    return read.join(files.select(number.alias("doc_id"), "size"), "doc_id").select("doc_id", "format", "size", "chars", "text")


@query("S2_classify_format", _UP + f"""SELECT doc_id, CASE WHEN ext = '.docx' THEN 'docx' WHEN ext = '.pdf' OR mime = 'application/pdf' THEN 'pdf' WHEN ext = '.doc' THEN 'reject'
 WHEN ext IN ({', '.join(sql.s(x) for x in v.TEXT_EXTENSIONS)}) OR starts_with(mime, 'text/') THEN 'text' WHEN regexp_matches(left(text, 2000), '[\\x00-\\x08\\x0e-\\x1f]') THEN 'reject' ELSE 'text' END AS format FROM u""")
def classify_format(spark, sf):
    return _uploads(spark, sf).select("doc_id", src.classify_format(F.col("filename"), F.col("mime"), F.col("text")).alias("format"))


def _half_blank(d):
    return d.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.lit(" \n\n ")).otherwise(F.col("text")))


@query("S3_reject_empty", "SELECT doc_id, doc_id % 5 <> 0 AND length(trim(text)) > 0 AS accepted FROM documents")
def reject_empty(spark, sf):
    d = _half_blank(inputs.docs(spark, sf))
    ok, bad = bl.reject_empty(d, bl.segment_documents(d))
    return ok.select("doc_id", F.lit(True).alias("accepted")).unionByName(bad.select("doc_id", F.lit(False).alias("accepted")))


@query("S7_upload_check", _UP + f"""SELECT doc_id, ('.' || lower(list_last(string_split(filename, '.')))) IN ({', '.join(sql.s(x) for x in v.UPLOAD_EXTENSIONS)}) AND sz > 0 AND sz <= 62914560 AS accepted, regexp_replace(filename, '\\.[^.]+$', '') AS title
 FROM (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 0 WHEN doc_id % 7 = 1 THEN 62914561 ELSE size END AS sz FROM u)""")
def upload_check(spark, sf):
    d = F.col("doc_id")
    size = F.when(d % 7 == 0, 0).when(d % 7 == 1, v.UPLOAD_BYTES + 1).otherwise(F.col("size"))
    return src.upload_check(_uploads(spark, sf).withColumn("size", size)).select("doc_id", "accepted", "title")


_MESSY = "replace(replace(text, '. ', '.' || chr(9) || chr(160) || '  '), chr(10), ' ' || chr(13) || chr(10) || chr(13) || chr(12288) || chr(10))"


def _messy(spark, sf):
    t = F.replace(F.replace("text", F.lit(". "), F.lit(".\t   ")), F.lit("\n"), F.lit(" \r\n\r　\n"))
    return inputs.documents(spark, sf).select("doc_id", t.alias("text"))


@query("T1_normalize_whitespace", f"SELECT doc_id, {sql.norm(_MESSY)} AS text FROM documents")
def normalize_whitespace(spark, sf):
    return _messy(spark, sf).select("doc_id", tx.normalize_whitespace(F.col("text")).alias("text"))


_CHUNKS = f"""SELECT doc_id, unnest(cs) AS chunk, CAST(generate_subscripts(cs, 1) - 1 AS INTEGER) AS chunk_no FROM (SELECT doc_id, regexp_split_to_array({sql.norm('text')}, '\\n{{2,}}') AS cs FROM docs)"""


@query("T2_split_chunks", sql.compose("docs", _CHUNKS))
def split_chunks(spark, sf):
    return inputs.docs(spark, sf).select("doc_id", F.posexplode(tx.split_chunks(F.col("text"))).alias("chunk_no", "chunk"))


@query("T3_explode_lines", sql.compose("docs", f"""SELECT doc_id, chunk_no, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line_no FROM (
 SELECT doc_id, chunk_no, list_filter(list_transform(string_split(chunk, chr(10)), lambda l: {sql.trim('l')}), lambda l: l <> '') AS ls FROM ({_CHUNKS}))"""))
def explode_lines(spark, sf):
    c = split_chunks(spark, sf)
    return c.select("doc_id", "chunk_no", F.posexplode(tx.chunk_lines(F.col("chunk"))).alias("line_no", "line"))


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs"


def _lines(spark, sf):
    return inputs.docs(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


@query("T4_looks_like_heading", sql.compose("docs", f"SELECT doc_id, t AS line, {sql.heading('t')} AS heading FROM (SELECT doc_id, {sql.trim('line')} AS t FROM ({_LINES}))"))
def looks_like_heading(spark, sf):
    return _lines(spark, sf).select("doc_id", tx.trim(F.col("line")).alias("line"), tx.looks_like_heading(F.col("line")).alias("heading"))


@query("T5_is_list_line", sql.compose("docs", f"SELECT doc_id, line, {sql.is_list('line')} AS is_list FROM ({_LINES})"))
def is_list_line(spark, sf):
    return _lines(spark, sf).select("doc_id", "line", tx.is_list_line(F.col("line")).alias("is_list"))


def _coalesced(spark, sf, mode):
    d = inputs.docs(spark, sf)
    return d.select("doc_id", F.posexplode(tx.coalesce_lines(F.col("text"), mode)).alias("n", "b")).select("doc_id", "n", F.col("b.type").alias("type"), F.col("b.text").alias("text"))


_CO = "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ch, k) - 1 AS INTEGER) AS n, ty AS type, tx AS text FROM co"


@query("T6_coalesce_lines", "WITH " + sql.CTES["docs"][1] + ",\n" + sql.coalesced("docs", "co") + "\n" + _CO)
def coalesce_lines(spark, sf):
    return _coalesced(spark, sf, "txt")


@query("T7_coalesce_lines_pdf", "WITH " + sql.CTES["docs"][1] + ",\n" + sql.coalesced("docs", "co", "pdf") + "\n" + _CO)
def coalesce_lines_pdf(spark, sf):
    return _coalesced(spark, sf, "pdf")


_MARKED = "replace(replace(text, ', ', '；！ '), '. ', '。 ')"


@query("T8_split_long_paragraph", f"""SELECT doc_id, unnest(ps) AS text, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS n FROM (SELECT doc_id, {sql.split_long('t')} AS ps FROM (SELECT doc_id, {_MARKED} AS t FROM documents))""")
def split_long_paragraph(spark, sf):
    t = F.replace(F.replace("text", F.lit(", "), F.lit("；！ ")), F.lit(". "), F.lit("。 "))
    d = inputs.documents(spark, sf).select("doc_id", t.alias("text"))
    return d.select("doc_id", F.posexplode(tx.split_long(F.col("text"))).alias("n", "text"))


@query("T9_has_math", f"SELECT doc_id, {sql.has_math('text')} AS math FROM documents")
def has_math(spark, sf):
    return inputs.documents(spark, sf).select("doc_id", tx.has_math(F.col("text")).alias("math"))


def _pieces(spark, sf):
    """Lines of documents as typed pieces: every fifth is an image, a table, a formula or empty."""
    d = inputs.documents(spark, sf).select("doc_id", F.posexplode(F.split(F.replace("text", F.lit(", "), F.lit("；")), "\n")).alias("piece_no", "line"))
    k = F.col("piece_no") % 5
    kind = F.when(k == 1, "image").when(k == 2, "table").when(k == 3, "formula").otherwise("paragraph")
    text = F.when((F.col("piece_no") % 7 == 0) | (k == 1), "").otherwise(F.col("line"))
    return d.select(
        "doc_id", "piece_no", kind.alias("type"), text.alias("text"), F.when((k == 3) & (F.length("line") % 2 == 0), "x_1").alias("tex"),
        F.when(k == 1, F.length("line") % 2).otherwise(0).alias("n_images"), F.lit(False).alias("rich"),
    )


@query("T10_finalize_blocks", f"""WITH l AS (SELECT doc_id, line, n - 1 AS piece_no FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT doc_id, string_split(replace(text, ', ', '；'), chr(10)) AS ls FROM documents))),
p AS (SELECT doc_id, piece_no, CASE piece_no % 5 WHEN 1 THEN 'image' WHEN 2 THEN 'table' WHEN 3 THEN 'formula' ELSE 'paragraph' END AS type, CASE WHEN piece_no % 7 = 0 OR piece_no % 5 = 1 THEN '' ELSE line END AS text,
 CASE WHEN piece_no % 5 = 3 AND length(line) % 2 = 0 THEN 'x_1' ELSE '' END AS tex, CASE WHEN piece_no % 5 = 1 THEN length(line) % 2 ELSE 0 END AS n_images FROM l),
e AS (SELECT doc_id, piece_no, type, unnest(ts) AS raw, generate_subscripts(ts, 1) AS j, CASE WHEN type = 'formula' THEN CASE WHEN tex = '' THEN text ELSE tex END ELSE '' END AS tex FROM (SELECT *, CASE type WHEN 'image' THEN ['［图片］'] WHEN 'table' THEN [text]
 WHEN 'formula' THEN ['$$' || CASE WHEN tex = '' THEN text ELSE tex END || '$$'] ELSE {sql.split_long('text')} END AS ts FROM p WHERE type <> 'image' OR n_images > 0)),
f AS (SELECT *, {sql.trim('raw')} AS text FROM e WHERE {sql.trim('raw')} <> '')
SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS idx, 'p' || row_number() OVER w AS block_id, type, text, tex, {sql.has_math('text')} AS rich FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY piece_no, j)""")
def finalize_blocks(spark, sf):
    return bl.finalize_blocks(_pieces(spark, sf)).select("doc_id", "idx", "block_id", "type", "text", F.coalesce("tex", F.lit("")).alias("tex"), "rich")


@query("T11_segment_documents", sql.compose("blocks", "SELECT doc_id, block_id, idx, type, text, rich FROM blocks"))
def segment_documents(spark, sf):
    return inputs.blocks(spark, sf)


@query("T11_segment_documents_raw", "WITH " + sql.segmented("documents", "rb") + " SELECT doc_id, block_id, idx, type, text, rich FROM rb")
def segment_documents_raw(spark, sf):
    return bl.segment_documents(inputs.documents(spark, sf))


# Words written as UTF-8 bytes and read back as Latin-1; the expected repair is the original text.
@query("T12_fix_filename", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || '.txt' ELSE source || '.txt' END AS filename FROM documents")
def fix_filename(spark, sf):
    broken = F.decode(F.encode(F.concat(F.col("text"), F.lit(".txt")), "UTF-8"), "ISO-8859-1")
    name = F.when(F.col("doc_id") % 2 == 0, broken).otherwise(F.concat("source", F.lit(".txt")))
    return inputs.documents(spark, sf).select("doc_id", tx.fix_filename(name).alias("filename"))


# No UTF-8 text read as Latin-1 has two lead bytes in a row, so a repair that asks for such a pair and for valid
# bytes leaves every title as it is.
@query("T13_repair_title", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Ã©tude ' || source ELSE text END AS title FROM documents")
def repair_title(spark, sf):
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Ã©tude "), "source")).otherwise(F.col("text"))
    return inputs.documents(spark, sf).select("doc_id", tx.repair_title(title).alias("title"))


@query("T14_backfill", sql.compose("blocks", """SELECT d.doc_id, '《' || d.filename || '》' AS filename, d.title, coalesce(b.n, 0) + 1 AS fixes FROM docs d LEFT JOIN (SELECT doc_id, count(*) FILTER (rich AND idx % 2 = 0) AS n FROM blocks GROUP BY doc_id) b ON b.doc_id = d.doc_id"""))
def backfill(spark, sf):
    b = inputs.blocks(spark, sf).withColumn("rich", F.when(F.col("idx") % 2 == 0, F.lit(None)).otherwise(F.col("rich")))
    d = inputs.doc_meta(spark, sf).withColumn("filename", F.decode(F.encode(F.concat(F.lit("《"), "filename", F.lit("》")), "UTF-8"), "ISO-8859-1"))
    return bl.backfill_documents(d, b)


def _tables(spark, sf):
    rows = F.transform(F.split("text", "\n"), lambda r: F.split(r, r"(?: \|)|\. "))
    return inputs.documents(spark, sf).select("doc_id", rows.alias("rows"))


_ROWS = "SELECT doc_id, list_transform(string_split(text, chr(10)), lambda r: regexp_split_to_array(r, '(?: \\|)|\\. ')) AS rows FROM documents"
_W = "list_max(list_transform(rows, lambda r: len(r)))"
_PAD = f"list_transform(rows, lambda r: list_concat(r, list_transform(range({_W} - len(r)), lambda i: '')))"


@query("T15_normalize_table", f"SELECT doc_id, array_to_string(list_transform({_PAD}, lambda r: array_to_string(list_transform(r, lambda c: {sql.trim('c')}), '¦')), chr(10)) AS cells, CAST(len(rows) AS INTEGER) AS n_rows, CAST({_W} AS INTEGER) AS cols FROM ({_ROWS})")
def normalize_table(spark, sf):
    t = _tables(spark, sf).select("doc_id", tb.normalize_table(F.col("rows")).alias("rows"))
    return t.select("doc_id", F.array_join(F.transform("rows", lambda r: F.array_join(r, "¦")), "\n").alias("cells"), F.size("rows").alias("n_rows"), F.size(F.get("rows", F.lit(0))).alias("cols"))


@query("T16_table_to_text", f"SELECT doc_id, '［表格 ' || len(rows) || ' 行 × ' || {_W} || ' 列］' || chr(10) || array_to_string(list_transform({_PAD}, lambda r: array_to_string(r, ' | ')), chr(10)) AS text FROM ({_ROWS})")
def table_to_text(spark, sf):
    return _tables(spark, sf).select("doc_id", tb.table_text(F.col("rows")).alias("text"))


@query("T17_expand_spans", "SELECT doc_id, array_to_string(flatten(list_transform(string_split(text, ' '), lambda w: list_concat([w], list_transform(range(greatest(length(w) % 4, 1) - 1), lambda i: '')))), '|') AS cells FROM documents")
def expand_spans(spark, sf):
    d = inputs.documents(spark, sf).select("doc_id", F.split("text", " ").alias("cells"))
    return d.select("doc_id", F.array_join(tb.expand_spans(F.col("cells"), F.transform("cells", lambda c: F.length(c) % 4)), "|").alias("cells"))


STYLES = ["heading 2", "Heading3", "标题 1", "4", "Title", "berschrift 5", "Normal", "标题", "heading 0", "HEADING 9"]


@query("T18_heading_level", f"""SELECT doc_id, CAST(CASE s WHEN 'heading 2' THEN 2 WHEN 'Heading3' THEN 3 WHEN '标题 1' THEN 1 WHEN '4' THEN 4 WHEN 'Title' THEN 1 WHEN 'berschrift 5' THEN 5 WHEN '标题' THEN 1 WHEN 'HEADING 9' THEN 9
 ELSE CASE WHEN o BETWEEN 0 AND 5 THEN o + 1 ELSE 0 END END AS INTEGER) AS level FROM (SELECT doc_id, n_chars % 8 - 1 AS o, ([{', '.join(sql.s(x) for x in STYLES)}])[doc_id % 10 + 1] AS s FROM documents)""")
def heading_level(spark, sf):
    style = F.element_at(F.array(*[F.lit(x) for x in STYLES]), (F.col("doc_id") % 10 + 1).cast("int"))
    return inputs.table(spark, sf, "documents").select("doc_id", tx.heading_level(style, F.col("n_chars") % 8 - 1).cast("int").alias("level"))


@query("K1_estimate_tokens", sql.compose("docs", f"SELECT doc_id, {sql.tokens('text')} AS tokens FROM docs"))
def estimate_tokens(spark, sf):
    return inputs.docs(spark, sf).select("doc_id", tk.estimate_tokens(F.col("text")).alias("tokens"))


@query("K2_estimate_messages_tokens", sql.compose("messages", f"SELECT doc_id, thread_key, CAST(sum({sql.tokens('content')} + 6) + 8 AS BIGINT) AS tokens FROM messages GROUP BY ALL"))
def messages_tokens(spark, sf):
    m = inputs.messages(spark, sf)
    return m.groupBy("doc_id", "thread_key").agg(tk.list_tokens(F.sum(tk.estimate_tokens(F.col("content"))), F.count("*")).alias("tokens"))


@query("K3_context_budget", sql.compose("blocks", f"""SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS total_chars, {sql.tokens("string_agg(text, chr(10))")} AS total_tokens, count(*) AS blocks, CAST(1500 AS BIGINT) AS budget, {sql.tokens("string_agg(text, chr(10))")} > 1500 AS over_budget FROM blocks GROUP BY doc_id"""))
def context_budget(spark, sf):
    return bl.context_budget(inputs.blocks(spark, sf), 1500)


@query("K4_fit_text", sql.compose("docs", f"SELECT doc_id, {sql.fit('text', '30 + doc_id % 50')} AS text FROM docs"))
def fit_text(spark, sf):
    return inputs.docs(spark, sf).select("doc_id", tk.fit_text(F.col("text"), 30 + F.col("doc_id") % 50).alias("text"))
