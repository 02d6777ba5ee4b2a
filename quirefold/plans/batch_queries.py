"""Queries on refinement batches and answer streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.operators import refine as rf
from quirefold.plans import inputs, sql
from quirefold.plans.registry import query
from quirefold.session import materialize, work_dir
from quirefold.streaming import answers as an
from quirefold.streaming import framing, messages, runs

c = sql.compose


def _line(src):
    return f"""(SELECT doc_id, idx, type, '[' || idx || '] (' || CASE type WHEN 'formula' THEN '公式' WHEN 'table' THEN '表格' WHEN 'heading' THEN '标题' ELSE '段落' END || ') ' || CASE WHEN type = 'table' THEN replace(text, chr(10), ' ⏎ ') ELSE text END AS line FROM {src} WHERE type <> 'image')"""


def _batches(src, p):
    """Batches found by walking the lines of each document one by one."""
    return f"""{p}cost AS MATERIALIZED (SELECT *, {sql.tokens('line')} + 8 AS cost, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k FROM {_line(src)}),
{p}walk AS (WITH RECURSIVE st AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS k, -1 AS idx, 0 AS batch, CAST(0 AS BIGINT) AS t, 0 AS n FROM {p}cost
 UNION ALL SELECT doc_id, k, idx, batch + CASE WHEN new THEN 1 ELSE 0 END, CASE WHEN new THEN cost ELSE t + cost END, CASE WHEN new THEN 1 ELSE n + 1 END FROM (
  SELECT s.doc_id, c.k, c.idx, s.batch, s.t, s.n, c.cost, s.n > 0 AND (s.t + c.cost > 5200 OR s.n >= 28) AS new FROM st s JOIN {p}cost c ON c.doc_id = s.doc_id AND c.k = s.k + 1)) SELECT * FROM st WHERE k > 0),
{p}batches AS MATERIALIZED (SELECT w.doc_id, w.idx, w.batch, c.line FROM {p}walk w JOIN {p}cost c ON c.doc_id = w.doc_id AND c.idx = w.idx)"""


sql.CTES["batches"] = (["typed"], _batches("typed", ""))


@query("A1_refine_lines", c("typed", f"SELECT doc_id, idx, line FROM {_line('typed')}"))
def refine_lines(spark, sf):
    return inputs.refine_lines(spark, sf)


@query("A2_chunk_by_budget", c("batches", "SELECT doc_id, idx, CAST(batch AS INTEGER) AS batch FROM batches"))
def chunk_by_budget(spark, sf):
    return rf.chunk_by_budget(inputs.refine_lines(spark, sf))


@query("A3_refine_prompts", c("batches docs", """SELECT b.doc_id, CAST(b.batch AS INTEGER) AS batch, CAST(count(*) AS INTEGER) AS n_blocks, '文档标题：' || any_value(d.title) || chr(10) || CASE WHEN any_value(o.o) IS NULL THEN '' ELSE '文档结构大纲（供参考，不需要你输出）：' || chr(10) || any_value(o.o) || chr(10) END
 || chr(10) || '请修正下面 ' || count(*) || ' 个内容块，输出严格的 JSON：' || chr(10) || chr(10) || string_agg(b.line, chr(10) ORDER BY b.idx) AS prompt FROM batches b JOIN docs d ON d.doc_id = b.doc_id
 LEFT JOIN (SELECT doc_id, string_agg('  第 ' || (idx + 1) || ' 块：' || text, chr(10) ORDER BY idx) AS o FROM typed WHERE type = 'heading' GROUP BY doc_id) o ON o.doc_id = b.doc_id GROUP BY b.doc_id, b.batch"""))
def refine_prompts(spark, sf):
    b = materialize(inputs.typed_blocks(spark, sf), "blocks")
    lines = rf.refine_lines(b)
    return rf.refine_prompts(inputs.doc_meta(spark, sf), b, lines, rf.chunk_by_budget(lines))


@query("A4_parse_json_loose", "SELECT doc_id, doc_id % 5 <> 4 AS valid, CASE WHEN doc_id % 5 <> 4 THEN text ELSE '' END AS said FROM documents")
def parse_json_loose(spark, sf):
    json = F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("n"), F.col("text"))).alias("blocks")))
    k = F.col("doc_id") % 5
    content = (
        F.when(k == 0, json).when(k == 1, F.concat(F.lit("```json\n"), json, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Sure: "), json, F.lit(" done.")))
        .when(k == 3, F.concat(F.lit("  ```\n"), json, F.lit("```  "))).otherwise(F.concat(F.lit("oops "), F.left(json, F.length(json) - 3)))
    )
    d = inputs.spread(inputs.documents(spark, sf)).select("doc_id", rf.loose_json(content).alias("json"))
    said = F.get(F.from_json("json", rf.RESPONSE)["blocks"], F.lit(0))["text"]
    ok = F.try_parse_json("json").isNotNull()
    return d.select("doc_id", ok.alias("valid"), F.when(ok, said).otherwise("").alias("said"))


sql.CTES["patches"] = (["batches"], """usable AS (SELECT *, (doc_id + batch) % 4 AS broken FROM batches),
patches AS (SELECT p.doc_id, p.batch, p.idx, a.type AS old_type, CASE idx5 WHEN 0 THEN 'formula' WHEN 1 THEN 'table' WHEN 2 THEN NULL ELSE 'paragraph' END AS type, CASE WHEN idx5 = 0 THEN '$$a_1+b$$' ELSE said END AS text,
 CASE WHEN idx5 = 0 THEN 'a_1+b' END AS tex, CASE WHEN idx5 <> 0 THEN regexp_matches(said, '\\$x\\$') OR MATHTEST END AS rich, CASE WHEN idx5 = 0 THEN said END AS readable,
 CASE WHEN idx5 = 1 THEN 'h1|h2/' || trim5 || '|' END AS rows FROM (SELECT u.doc_id, u.batch, u.idx, u.idx % 5 AS idx5, TRIMSAID AS said, TRIM5 AS trim5 FROM usable u JOIN blocks b ON b.doc_id = u.doc_id AND b.idx = u.idx WHERE u.broken <> 3) p JOIN typed a ON a.doc_id = p.doc_id AND a.idx = p.idx)"""
    .replace("MATHTEST", sql.has_math("said")).replace("TRIMSAID", sql.trim("' fixed ' || b.text || CASE WHEN u.idx % 2 = 0 THEN ' $x$' ELSE '' END")).replace("TRIM5", sql.trim("regexp_replace(b.text, '\\n+', ' ', 'g')")))
_PATCH = "coalesce(type, '') AS type, text, coalesce(tex, '') AS tex, coalesce(rich, false) AS rich, coalesce(readable, '') AS readable, coalesce(rows, '') AS rows"


def _patch_cols(df):
    e = lambda x: F.coalesce(x, F.lit("")).alias(x)
    rows = F.coalesce(F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/"), F.lit(""))
    return df.select(*[x for x in ("doc_id", "batch", "idx", "block_id", "ai_refined") if x in df.columns], e("type"), "text", e("tex"), F.coalesce("rich", F.lit(False)).alias("rich"), e("readable"), rows.alias("rows"))


def _refined(spark, sf):
    responses, batches, b = inputs.refine_responses(spark, sf)
    parsed = rf.parse_responses(responses)
    return responses, batches, b, parsed, rf.build_patches(parsed, batches, b)


@query("A5_build_patches", c("patches", f"SELECT doc_id, CAST(batch AS INTEGER) AS batch, idx, {_PATCH} FROM patches"))
def build_patches(spark, sf):
    return _patch_cols(_refined(spark, sf)[4])


_APPLIED = """SELECT a.doc_id, a.block_id, a.idx, coalesce(p.type, a.type) AS type, coalesce(p.text, a.text) AS text, p.tex, coalesce(p.rich, a.rich) AS rich, p.readable, p.rows, p.idx IS NOT NULL AS ai_refined FROM typed a LEFT JOIN patches p ON p.doc_id = a.doc_id AND p.idx = a.idx"""


@query("A6_apply_refine", c("patches", f"SELECT doc_id, block_id, idx, ai_refined, {_PATCH} FROM ({_APPLIED})"))
def apply_refine(spark, sf):
    _, _, b, _, patches = _refined(spark, sf)
    return _patch_cols(rf.apply_refine(b, patches))


@query("A7_refine_usage", c("patches", """SELECT u.doc_id, CAST(sum(k * 1200) AS BIGINT) AS prompt_tokens, CAST(sum(k * 620) AS BIGINT) AS completion_tokens, CAST(sum(k * 1820) AS BIGINT) AS total_tokens, CAST(sum(n) AS BIGINT) AS calls, max_by(CASE WHEN n = 2 THEN 'm-2' ELSE 'm-1' END, batch) AS model,
 any_value(coalesce(p.n_p, 0)) AS blocks_refined FROM (SELECT DISTINCT doc_id, batch, CASE WHEN broken >= 2 THEN 2 ELSE 1 END AS n, CASE WHEN broken >= 2 THEN 3 ELSE 1 END AS k FROM usable) u LEFT JOIN (SELECT doc_id, count(*) AS n_p FROM patches GROUP BY doc_id) p ON p.doc_id = u.doc_id GROUP BY u.doc_id"""))
def refine_usage(spark, sf):
    responses, _, _, _, patches = _refined(spark, sf)
    return rf.refine_usage(responses, patches)


@query("A8_refine_errors", c("patches", "SELECT doc_id, CAST(batch AS INTEGER) AS batch, min(idx) + 1 AS block_from, max(idx) + 1 AS block_to FROM usable WHERE broken = 3 GROUP BY doc_id, batch"))
def refine_errors(spark, sf):
    _, batches, _, parsed, _ = _refined(spark, sf)
    return rf.refine_errors(batches, parsed)


@query("A9_snapshot_restore", c("patches typed", f"SELECT 0 AS version, doc_id, block_id, type, text FROM typed UNION ALL SELECT 1, doc_id, block_id, type, text FROM ({_APPLIED}) UNION ALL SELECT 2, doc_id, block_id, type, text FROM typed WHERE doc_id % 3 = 0"))
def snapshot_restore(spark, sf):
    """Both versions as they are kept, and a restored third one of every third document."""
    _, _, b, _, patches = _refined(spark, sf)
    versions = rf.snapshot(b.drop("rows"), rf.apply_refine(b, patches).drop("rows")).select("version", "doc_id", "block_id", "type", "text")
    restored = rf.restore_local(versions.where(F.col("doc_id") % 3 == 0)).withColumn("version", F.lit(2))
    return versions.unionByName(restored)


@query("A9_keep_logs", "SELECT doc_id, run_at, CAST(nth AS INTEGER) AS nth FROM (SELECT conv_id AS doc_id, turn AS run_at, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth FROM conversations) WHERE nth <= 5")
def keep_logs(spark, sf):
    runs = inputs.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("at"))
    return rf.keep_logs(runs).withColumnRenamed("at", "run_at")


@query("A10_refine_progress", c("patches", "SELECT doc_id, count(DISTINCT batch) AS total, count(DISTINCT batch) FILTER (broken < 2) AS done, CAST(floor(count(DISTINCT batch) FILTER (broken < 2) * 100.0 / count(DISTINCT batch) + 0.5) AS INTEGER) AS percent FROM usable GROUP BY doc_id"))
def refine_progress(spark, sf):
    responses, batches, _ = inputs.refine_responses(spark, sf)
    first = responses.groupBy("doc_id", "batch").agg(F.count("*").alias("n")).filter("n = 1")
    return rf.refine_progress(batches, first)


# --- answer streams ---------------------------------------------------------------------------------------------

sql.CTES["requests"] = ([], "requests AS (SELECT conv_id * 1000 + turn AS req_id, conv_id AS doc_id, turn AS at, text FROM conversations WHERE role = 'assistant')")


_FRAMED = "SELECT req_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars, CAST(sum(line_no * length(line)) AS BIGINT) AS places FROM (SELECT req_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM (SELECT req_id, string_split(text || chr(10) || 'end' || chr(10) || text, chr(10)) AS ls FROM requests)) GROUP BY req_id"


def _chunks(spark, sf):
    """Answers, a line and the answers again, cut every 18 characters."""
    t = F.concat("text", F.lit("\nend\n"), "text")
    n = F.ceil(F.length(t) / 18).cast("int")
    r = inputs.table(spark, sf, "conversations").filter(F.col("role") == "assistant").select((F.col("conv_id") * 1000 + F.col("turn")).alias("req_id"), t.alias("t"), n.alias("n"))
    chunks = r.select("req_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substr("t", i * 18 + 1, F.lit(18)))).alias("seq", "chunk"))
    return chunks.withColumn("seq", F.col("seq").cast("long"))


def _framed_cols(lines):
    return lines.groupBy("req_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars"), F.sum(F.col("line_no") * F.length("line")).alias("places"))


@query("V1_frame_lines", c("requests", _FRAMED))
def frame_lines(spark, sf):
    return _framed_cols(an.frame_lines(_chunks(spark, sf)))


def _as_files(spark, df, name, files, order):
    """The rows as files by ranges of a column, so that a stream of one file a batch meets them apart."""
    folder = work_dir(spark, name)
    df.repartitionByRange(files, order).write.parquet(folder)
    return folder


@query("V1_frame_lines_stream", c("requests", _FRAMED))
def frame_lines_stream(spark, sf):
    """The same chunks as a stream of several files: lines, and blocks of 64 chunks, go on from file to file."""
    chunks = _chunks(spark, sf)
    stream = runs.read_stream(spark, _as_files(spark, chunks, "chunks", 3, "seq"), "*.parquet", chunks.schema, 1)
    place = work_dir(spark, "framing")
    framing.frame_available(stream, place, 64)
    return _framed_cols(framing.lines(spark, place, framing.framed(stream, 64).schema))


def _events(spark, sf):
    return an.parse_events(an.frame_lines(inputs.deltas(spark, sf)))


@query("V2_parse_events", c("requests", "SELECT req_id, CAST(ceil(length(text) / 18.0) AS BIGINT) + CASE WHEN req_id % 5 = 0 THEN 0 ELSE 1 END AS events FROM requests"))
def parse_events(spark, sf):
    return _events(spark, sf).groupBy("req_id").agg(F.count("*").alias("events"))


_FOLDED = "SELECT req_id, text AS content, CASE req_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'length' ELSE 'stop' END AS finish_reason, CASE WHEN req_id % 5 = 0 THEN 0 ELSE 15 END AS total_tokens FROM requests"


def _folded_cols(f):
    return f.select("req_id", "content", F.coalesce("finish_reason", F.lit("")).alias("finish_reason"), F.coalesce("usage.total_tokens", F.lit(0)).cast("int").alias("total_tokens"))


@query("V3_fold_deltas", c("requests", _FOLDED))
def fold_deltas(spark, sf):
    return _folded_cols(an.fold_deltas(an.deltas(_events(spark, sf))))


@query("V3_fold_deltas_stream", c("requests", _FOLDED))
def fold_deltas_stream(spark, sf):
    """The same chunks as a stream of several files; every file ends inside lines."""
    chunks = inputs.deltas(spark, sf)
    stream = runs.read_stream(spark, _as_files(spark, chunks, "deltas", 3, "seq"), "*.parquet", chunks.schema, 1)
    return _folded_cols(an.fold_available(spark, stream, work_dir(spark, "folding"), 64))


def _outcomes(spark, sf):
    return an.classify_outcome(an.fold_deltas(an.deltas(_events(spark, sf))))


@query("V4_classify_outcome", c("requests", "SELECT req_id, CASE req_id % 5 WHEN 0 THEN 'interrupted' WHEN 1 THEN 'output_truncated' ELSE 'done' END AS outcome, CASE WHEN req_id % 5 = 0 THEN '回答连接提前结束，请重试。' ELSE '' END AS error FROM requests"))
def classify_outcome(spark, sf):
    return _outcomes(spark, sf).select("req_id", "outcome", "error")


@query("V5_persist_answers", c("requests", "SELECT req_id, doc_id, CASE WHEN req_id % 5 = 0 AND doc_id % 2 <> 0 THEN '' ELSE text END AS content, CASE WHEN req_id % 5 = 0 AND doc_id % 2 <> 0 THEN '回答连接提前结束，请重试。' ELSE '' END AS error, req_id % 5 = 0 AND doc_id % 2 = 0 AS interrupted FROM requests"))
def persist_answers(spark, sf):
    return an.persist_answers(_outcomes(spark, sf), inputs.requests(spark, sf)).select("req_id", "doc_id", "content", "error", "interrupted")


_APPENDED = """SELECT doc_id, thread_key, CAST(row_number() OVER (PARTITION BY doc_id, thread_key ORDER BY role <> 'user', n) - 1 AS BIGINT) AS seq, role, content FROM (
 SELECT conv_id AS doc_id, 'p1' AS thread_key, turn AS n, role, text AS content FROM conversations WHERE role = 'user'
 UNION ALL SELECT doc_id, 'p1', "at", 'assistant', CASE WHEN req_id % 5 = 0 AND doc_id % 2 <> 0 THEN '' ELSE text END FROM requests)"""


@query("V5_append_answers", c("requests", _APPENDED))
def append_answers(spark, sf):
    """Questions stored in a message table, answers appended to it as a stream of several files; all files come
    twice, as after a failure behind their commit."""
    place = work_dir(spark, "messages")
    asked = inputs.table(spark, sf, "conversations").filter(F.col("role") == "user").select(F.col("conv_id").alias("doc_id"), F.lit("p1").alias("thread_key"), F.col("turn").alias("at"), "role", F.col("text").alias("content"))
    messages.append_once(spark, place, "import", 0, asked)
    answers = an.persist_answers(_outcomes(spark, sf), inputs.requests(spark, sf)).select("doc_id", "thread_key", "at", "role", "content")
    folder = work_dir(spark, "answers")
    for part in (F.col("at") < 3, F.col("at") >= 3):
        # The answers of a thread lie in one file of each part, earlier ones in earlier files.
        answers.where(part).repartition(2, "doc_id", "thread_key").write.mode("append").parquet(folder)
    for _ in range(2):
        stream = runs.read_stream(spark, folder, "*.parquet", answers.schema, 1)
        runs.run_available(stream, messages.appender(place, "answers"), "append")
    return messages.read_messages(spark, place, answers.drop("at").schema.add("seq", "long")).select("doc_id", "thread_key", "seq", "role", "content")


@query("V6_incremental_refine", c("patches", f"SELECT doc_id, CAST(batch AS INTEGER) AS batch, idx, {_PATCH} FROM patches"))
def incremental_refine(spark, sf):
    """Responses as a file stream whose files hold one attempt each: every micro-batch is turned into patches at once,
    and a late further answer of a refined batch changes nothing."""
    responses, batches, b = inputs.refine_responses(spark, sf)
    responses = materialize(responses, "responses")
    late = responses.where(F.col("content").contains("{") & F.try_parse_json(rf.loose_json(F.col("content"))).isNotNull()).withColumn("attempt", F.lit(2))
    late = late.withColumn("content", F.replace("content", F.lit(" fixed "), F.lit(" late ")))
    every = responses.union(late)
    # The files of an attempt are written by all tasks and read as one micro-batch.
    folder, files = work_dir(spark, "responses"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    for attempt in range(3):
        every.where(F.col("attempt") == attempt).repartition(files).write.mode("append").parquet(folder)
    stream = runs.read_stream(spark, folder, "*.parquet", every.schema, files)
    place = work_dir(spark, "patches")
    an.incremental_refine(stream, batches, b, place)
    return _patch_cols(an.current_patches(spark, place))


@query("V7_question_counts", "SELECT conv_id AS doc_id, count(*) FILTER (role = 'user') AS questions FROM conversations GROUP BY conv_id")
def question_counts(spark, sf):
    """Conversations as a file stream in two runs, counts kept current: the second run goes on where the first ended."""
    turns = inputs.table(spark, sf, "conversations")
    folder, place = work_dir(spark, "turns"), work_dir(spark, "counts")
    for part in (F.col("turn") % 2 == 0, F.col("turn") % 2 != 0):
        turns.where(part).write.mode("append").parquet(folder)
        stream = runs.read_stream(spark, folder, "*.parquet", turns.schema).withColumnRenamed("conv_id", "doc_id")
        counts = runs.latest_per_key(spark, an.question_counts(stream), ["doc_id"], place)
    return counts
