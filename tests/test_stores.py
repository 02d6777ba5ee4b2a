"""Sources and sinks: stores of several documents, export files, the search index."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quirefold.operators import retrieval
from quirefold.session import work_dir
from quirefold.sources import documents as src
from quirefold.sources import sinks


def message(n, **more):
    return {"id": f"m{n}", "role": "user", "content": f"c{n}", **more}


STORE = {
    "version": 2,
    "documents": {
        "a": {"id": "a", "title": "A", "size": 7, "paragraphs": [{"id": "p1", "index": 0, "text": "one", "rich": True, "page": "no number"}, {"id": "p2", "index": 1, "text": "two"}], "threads": {"p1": {"messages": [message(1), message(2, interrupted=True, citedParagraphIds=["p2", "p9"])]}, "__cross__": {"messages": [message(3)]}}},
        "b": {"id": "b", "title": None, "paragraphs": [], "threads": {}},
    },
}


def test_stores_of_many_documents_and_lines(spark):
    line = {"id": "c", "title": "C", "threads": {"p1": {"messages": [message(4)]}}}
    values = spark.createDataFrame([(json.dumps(STORE),), (json.dumps(line),), ("{broken",), (None,)], "value string")
    t = src.load_store(values)
    assert sorted((r["doc_id"], r["title"], r["size"]) for r in t["documents"].collect()) == [("a", "A", 7), ("b", None, None), ("c", "C", None)]
    assert sorted((r["doc_id"], r["block_id"], r["idx"], r["text"], r["rich"], r["page"]) for r in t["blocks"].collect()) == [("a", "p1", 0, "one", True, None), ("a", "p2", 1, "two", False, None)]
    got = sorted((r["doc_id"], r["thread_key"], r["seq"], r["msg_id"], r["interrupted"], r["cited"]) for r in t["messages"].collect())
    assert got == [("a", "__cross__", 0, "m3", False, None), ("a", "p1", 0, "m1", False, None), ("a", "p1", 1, "m2", True, ["p2", "p9"]), ("c", "p1", 0, "m4", False, None)]


def test_exports_are_files_of_their_names(spark):
    path = work_dir(spark, "exports")
    rows = [(d, f"T/{d}: x", s, i, 0, 0, f"{d}-{s}-{i}") for d in range(5) for s in (1, 0) for i in range(30)]
    random.Random(1).shuffle(rows)
    sinks.write_exports(spark.createDataFrame(rows, "doc_id long, title string, section long, item_no long, qa_no long, line long, body string").repartition(4), path)
    got = {r["doc_id"]: (r["name"], r["body"]) for r in sinks.read_exports(spark, path).collect()}
    assert got == {d: (f"T_{d}_ x-问答记录.md", "\n".join(f"{d}-{s}-{i}" for s in (0, 1) for i in range(30))) for d in range(5)}
    assert {p.name.split("-")[0] for p in Path(path).iterdir()} == {"part"}


def test_failed_exports_leave_no_file(spark):
    path = work_dir(spark, "exports")
    bad = F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.lit("body")).cast("string")
    rows = spark.range(20).repartition(4).select(F.col("id").cast("string").alias("name"), bad.alias("body"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_files(rows, path)
    assert not list(Path(path).glob("part-*"))


def test_a_retried_attempt_counts_once(spark):
    """Only folders named by commit messages stay; those of other attempts go."""
    path = work_dir(spark, "exports")
    writer = sinks.export_source()({"path": path}).writer(None, False)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"name": ["x.md"], "body": ["text"]})
    lost, done = writer.write(iter([batch])), writer.write(iter([batch]))
    assert lost.folder != done.folder
    writer.commit([done, None])
    assert [str(p.relative_to(path)) for p in sorted(Path(path).rglob("*")) if p.is_file()] == ["part-0/x.md"]


def test_index_finds_what_a_scan_finds(spark):
    r = random.Random(8)
    texts = ["".join(r.choice("abAB é日本") for _ in range(r.randrange(30))) for _ in range(200)]
    blocks = spark.createDataFrame([(i // 5, i % 5, f"p{i % 5 + 1}", t) for i, t in enumerate(texts)], "doc_id long, idx int, block_id string, text string")
    queries = [(0, "ab"), (1, "ABA"), (2, "é"), (3, "日本a"), (4, " "), (5, "none of it"), (6, "abab"), (7, "ab"), (8, None)]
    path = work_dir(spark, "index")
    retrieval.write_index(blocks, path)
    got = sorted((x["q_id"], x["doc_id"], x["idx"]) for x in retrieval.search_indexed(spark.createDataFrame(queries, "q_id long, query string"), blocks, path).collect())
    assert got == sorted((q, i // 5, i % 5) for q, s in queries if s and s.strip() for i, t in enumerate(texts) if s.strip().lower() in t.lower())
    # The rarest run decides what is read.
    rare = retrieval.indexed_candidates(spark.createDataFrame([(1, "日本a")], "q_id long, query string"), path).count()
    assert rare <= sum("日本a" in t.lower() for t in texts)


def test_exports_are_read_by_folders_and_parsed_once(spark, tmp_path):
    from quirefold.plans import thread_queries

    path = f"{tmp_path}/out"
    rows = [(i, f"t + %{i}", 1, 0, 0, 0, '{"document":{"title":"t","blocks":1,"questions":0},"items":[{"paragraphId":"p1","type":"cross","text":"x","qa":[{"question":"q"}]},{"paragraphId":"p2"}]}') for i in range(20)]
    sinks.write_exports(spark.createDataFrame(rows, "doc_id long, title string, section long, item_no long, qa_no long, line long, body string"), path, "json", "")
    read = sinks.read_exports(spark, path)
    assert {r["doc_id"]: (r["name"], r["body"]) for r in read.collect()} == {r[0]: (f"t + %{r[0]}-问答记录.json", r[-1]) for r in rows}
    flat = thread_queries._flattened(read.where("doc_id = 3"))
    assert "binaryFile" not in read._jdf.queryExecution().toString() and "Union" not in flat._jdf.queryExecution().toString()
    end = (1 << 31) - 1
    assert sorted(tuple(r) for r in flat.collect()) == [(3, "item", 1, -1, "p2"), (3, "item", end, -1, "p1|cross|x"), (3, "qa", end, 0, "q|||"), (3, "summary", -2, -1, "t|1|0")]


def test_titles_come_to_dealt_bodies(spark, monkeypatch):
    """Bodies are dealt once, by document, also where their titles stand in another table."""
    bodies = spark.createDataFrame([(d, 0, 0, 0, n, f"{d}{n}") for d in (1, 2, 3) for n in (1, 0)], "doc_id long, section long, item_no long, qa_no long, line long, body string")
    titles = spark.createDataFrame([(1, "a/b"), (2, None)], "doc_id long, title string").hint("merge")
    kept = {}
    monkeypatch.setattr(sinks, "write_files", lambda rows, path, sep="": kept.update(rows=rows))
    sinks.write_exports(bodies, "nowhere", "json", "", titles=titles)
    assert kept["rows"]._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 2
    got = {}
    for r in kept["rows"].collect():
        got.setdefault(r["name"].split("-")[0], []).append(r["body"])
    assert got == {"1": ["10", "11"], "2": ["20", "21"]}
