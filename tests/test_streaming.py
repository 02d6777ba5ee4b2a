"""Streams give what the batch forms give, wherever chunks and files are cut, and later runs go on from earlier ones."""

import random

from pyspark.sql import functions as F

from quirefold.operators import refine
from quirefold.session import work_dir
from quirefold.streaming import answers, framing, messages, runs

CHUNK = "req_id long, seq long, chunk string"


def add_file(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def cut(r, req, text):
    """Chunks of random lengths, some empty."""
    out, at = [], 0
    while at < len(text):
        n = r.choice([0, 1, 2, 5, 9])
        out.append(text[at : at + n])
        at += n
    return [(req, i, c) for i, c in enumerate(out or [""])]


def test_framing_equals_batch_wherever_files_end(spark):
    """Files in any order, chunks twice, blocks without a line feed; blocks of 3 chunks, read file by file in two runs."""
    r = random.Random(5)
    texts = {1: "a\nbb\n\nccc\nd", 2: "no feed at all in this one, and long enough for several blocks", 3: "\n\n\n", 4: "", 5: "x\n" * 30 + "end", 6: "日本\n語" * 9}
    rows = [c for req, t in texts.items() for c in cut(r, req, t)]
    shuffled = rows + r.sample(rows, 10)
    r.shuffle(shuffled)
    folder, place = work_dir(spark, "chunks"), work_dir(spark, "place")
    open_reader = lambda: runs.read_stream(spark, folder, "*.parquet", spark.createDataFrame([], CHUNK).schema, 1)
    half = len(shuffled) // 2
    for begin in (0, half):
        for at in range(begin, begin + half, 25):
            add_file(spark, folder, shuffled[at : min(at + 25, begin + half)], CHUNK)
        query = framing.frame_available(open_reader(), place, 3)
        assert sum(p["numInputRows"] for p in query.recentProgress) == half
    schema = framing.framed(open_reader(), 3).schema
    got = {tuple(x) for x in framing.lines(spark, place, schema).collect()}
    known = spark.createDataFrame(sorted(set(shuffled[: 2 * half])), CHUNK)
    assert got == {tuple(x) for x in answers.frame_lines(known).select("req_id", "line_no", "line").collect()}
    if set(rows) == set(shuffled[: 2 * half]):
        assert got == {(q, i, line) for q, t in texts.items() for i, line in enumerate(t.split("\n"))}


def test_folding_a_stream_cut_inside_lines(spark):
    wire = 'data: {"model":"m","choices":[{"delta":{"content":"Ab"}}]}\n: ping\ndata: {"choices":[{"delta":{"content":"cd","reasoning_content":"why"}}]}\ndata: {"choices":[{"delta":{"content":"ef"},"finish_reason":"stop"}]}\ndata: [DONE]'
    chunks = [(q, i, wire[7 * i : 7 * i + 7]) for q in (1, 2) for i in range(-(-len(wire) // 7))]
    folder, place = work_dir(spark, "chunks"), work_dir(spark, "place")
    open_reader = lambda: runs.read_stream(spark, folder, "*.parquet", spark.createDataFrame([], CHUNK).schema)
    add_file(spark, folder, chunks[:11], CHUNK)
    (first,) = answers.fold_available(spark, open_reader(), place, 4).collect()
    assert (first["req_id"], first["content"], first["finish_reason"], first["model"]) == (1, "Ab", None, "m")
    add_file(spark, folder, chunks[11:], CHUNK)
    got = sorted(answers.fold_available(spark, open_reader(), place, 4).select("req_id", "content", "reasoning", "finish_reason", "model").collect())
    assert [tuple(x) for x in got] == [(q, "Abcdef", "why", "stop", "m") for q in (1, 2)]


def test_messages_are_appended_once(spark, monkeypatch):
    place = work_dir(spark, "messages")
    schema = "doc_id long, thread_key string, at long, content string"
    batch = lambda rows: spark.createDataFrame(rows, schema)
    first, second = batch([(1, "p1", 5, "b"), (1, "p1", 2, "a"), (2, "p1", 1, "x")]), batch([(1, "p1", 9, "c"), (1, "p2", 9, "n")])
    stored = lambda: sorted(map(tuple, messages.read_messages(spark, place, batch([]).drop("at").schema.add("seq", "long")).collect()))
    assert stored() == []
    assert messages.append_once(spark, place, "answers", 0, first)
    with monkeypatch.context() as m:
        # A failure behind the write of the messages, before the commit.
        m.setattr(messages.folders, "mark", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        try:
            messages.append_once(spark, place, "answers", 1, second)
            raise AssertionError
        except OSError:
            pass
    want = [(1, "p1", "a", 0), (1, "p1", "b", 1), (2, "p1", "x", 0)]
    assert stored() == want
    assert messages.append_once(spark, place, "answers", 1, second) and not messages.append_once(spark, place, "answers", 1, second)
    assert messages.append_once(spark, place, "import", 1, batch([(2, "p1", 0, "y")]))
    assert stored() == sorted([*want, (1, "p1", "c", 2), (1, "p2", "n", 0), (2, "p1", "y", 1)])


def test_lowest_attempt_wins_over_micro_batches(spark):
    """A later lower attempt replaces a higher one, a later higher one changes nothing, one without JSON does not count."""
    json = lambda text: '{"blocks":[{"n":0,"type":"paragraph","text":"%s"}]}' % text
    schema = "doc_id long, batch int, attempt int, content string"
    folder, place = work_dir(spark, "responses"), work_dir(spark, "patches")
    batches = spark.createDataFrame([(d, 0, 0) for d in (1, 2, 3)], "doc_id long, idx int, batch int")
    blocks = spark.createDataFrame([(d, 0, "paragraph") for d in (1, 2, 3)], "doc_id long, idx int, type string")
    open_reader = lambda: runs.read_stream(spark, folder, "*.parquet", spark.createDataFrame([], schema).schema, 1)
    current = lambda: sorted((x["doc_id"], x["text"]) for x in answers.current_patches(spark, place).collect())
    add_file(spark, folder, [(1, 0, 1, json("one")), (2, 0, 0, "no json"), (3, 0, 0, json("zero"))], schema)
    add_file(spark, folder, [(2, 0, 2, json("two"))], schema)
    answers.incremental_refine(open_reader(), batches, blocks, place)
    assert current() == [(1, "one"), (2, "two"), (3, "zero")]
    add_file(spark, folder, [(1, 0, 0, json("zero")), (2, 0, 1, json("one")), (3, 0, 1, json("one"))], schema)
    query = answers.incremental_refine(open_reader(), batches, blocks, place)
    assert sum(p["numInputRows"] for p in query.recentProgress) >= 3
    assert current() == [(1, "zero"), (2, "one"), (3, "zero")]
    assert refine.first_valid(spark.createDataFrame([(2, 0, 0, "no json")], schema)).count() == 0


def test_a_second_run_reads_only_new_files(spark):
    folder, place, schema = work_dir(spark, "turns"), work_dir(spark, "counts"), "doc_id long, role string"
    read = lambda: answers.question_counts(runs.read_stream(spark, folder, "*.parquet", spark.createDataFrame([], schema).schema))
    add_file(spark, folder, [(1, "user"), (1, "assistant"), (2, "user")], schema)
    counts = runs.latest_per_key(spark, read(), ["doc_id"], place)
    assert sorted(map(tuple, counts.collect())) == [(1, 1), (2, 1)]
    add_file(spark, folder, [(1, "user"), (3, "user")], schema)
    seen = []
    query = runs.run_available(read(), lambda batch, number: (seen.append(number), runs.batches_into(f"{place}/updates")(batch, number)), place=place)
    assert sum(p["numInputRows"] for p in query.recentProgress) == 2 and seen == [1]
    counts = runs.latest_per_key(spark, read(), ["doc_id"], place)
    assert sorted(map(tuple, counts.collect())) == [(1, 2), (2, 1), (3, 1)]
    assert runs.latest_per_key(spark, read(), ["doc_id"], place).agg(F.sum("questions")).first()[0] == 4


def test_texts_and_answers_are_spread_over_tasks(spark, tmp_path):
    """One file of one row group is read by one task; texts are then dealt to all, and so are the files of a stream."""
    from pathlib import Path

    from quirefold.plans import batch_queries, inputs

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = [(i, "Some words here. And more.", "s", 26) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert batch_queries.parse_json_loose(spark, str(tmp_path)).rdd.getNumPartitions() == n
    assert inputs.docs(spark, str(tmp_path)).rdd.getNumPartitions() == n
    batch_queries.incremental_refine(spark, str(tmp_path))
    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    newest = sorted(base.glob("responses-*"), key=lambda f: f.stat().st_mtime_ns)[-1]
    assert len(list(newest.glob("*.parquet"))) > 3
