"""Ranked search, collocations and token counts against plain versions; repeated and hot rows of captures and windows."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirefold.llm import decontaminate, heapcount, lexical, phrases, queries, sql, warc
from quirefold.llm.common import ship, utf8

SCHEMA = "doc_id long, text string, lang string, source string, terms string, score string, rank string, phrase string, n_tokens string"
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def frame(spark, rows):
    """doc_id, text, lang and columns whose names the operators use."""
    return spark.createDataFrame([(i, t, g, "s", "x", "x", "x", "x", "x") for i, t, g in rows], SCHEMA).repartition(4)


def search_brute(docs, items, k=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    own = [(i, w) for i, t in docs if (w := words(t))]
    n_docs, total = len(own), sum(len(w) for _, w in own)
    counted = [(i, len(w), collections.Counter(w)) for i, w in own]
    df = collections.Counter(t for _, _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, n, c in counted:
            m = 75 + 25 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i, s))
        out += [(item, r + 1, i, s) for r, (_, _, i, s) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_search_is_exact(spark, empty, monkeypatch, small):
    """The same rows whatever the sizes of tiles, blocks, slices and passes; ties, repeats, nulls and a very long text."""
    if small:
        for name, value in (("TILE_DOCS", 7), ("BLOCK_ITEMS", 3), ("TILE_CELLS", 70), ("SLICE_WEIGHT", 5000), ("PASS_ITEMS", 5), ("STEP", 50)):
            monkeypatch.setattr(lexical, name, value)
    r = random.Random(4)
    text = lambda n: " ".join(r.choice(["Ab", "éa", "x9", "the", "日本", "rare", "w%d" % r.randrange(60)]) + r.choice(["", ",", "."]) for _ in range(n))
    rows = [(i, text(r.randrange(1, 30)), "en") for i in range(150)]
    rows += [(1000 + i, "the same text of copies", None) for i in range(30)] + [(1000, "the same text of copies", "en"), (None, "the same text of copies", "en"), (None, None, None), (2000, "", "en"), (2001, " .. ", "en"), (2002, "the " * 20_000 + "rare", "en")]
    items = [(k, text(12)) for k in range(9)] + [(3, text(5)), (None, "the same the"), (50, None), (51, "..."), (52, "nowhere"), (53, "rare " * 3000)]
    bench = spark.createDataFrame([(i, t, "x", "x") for i, t in items], "item_id long, text string, doc_id string, row string")
    got = lexical.search(frame(spark, rows), bench)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect()), key=repr) == search_brute([r[:2] for r in rows], items)
    assert lexical.search(empty, bench).count() == 0 and lexical.search(frame(spark, rows), bench.limit(0)).count() == 0


def test_search_slices_keep_every_weight():
    """Weights larger than a slice may hold are dealt in parts; each item's sum in a slice stays below 2^53 / impact."""
    terms, weights = [np.array([1, 5]), np.array([5, 9])], [np.array([3 * lexical.SLICE_WEIGHT + 5, 7]), np.array([lexical.SLICE_WEIGHT, 1])]
    slices = lexical.sliced(terms, weights)
    total = collections.Counter()
    for s in slices:
        assert all(s.value[s.item == k].sum() <= lexical.SLICE_WEIGHT for k in (0, 1)) and lexical.SLICE_WEIGHT * lexical.IMPACT < 2**53
        for row, item, value in zip(s.row.tolist(), s.item.tolist(), s.value.tolist()):
            total[int(s.terms[row]), item] += int(value)
    assert total == {(1, 0): 3 * lexical.SLICE_WEIGHT + 5, (5, 0): 7, (5, 1): lexical.SLICE_WEIGHT, (9, 1): 1}


def collocations_brute(rows):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, t, g in rows:
        g = "und" if g is None else g
        for piece in re.split("[.,;:!?\x0a-\x0d]", (t or "").translate(LOW)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[g] += len(w)
            for k in (1, 2, 3):
                f[g].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for g, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= 10}
        gone = {p[j : j + 2] for p, a in cand.items() if len(p) == 3 for j in (0, 1) if 100 * a >= 50 * c[p[j : j + 2]]}
        found = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), p, c[p[:k]], c[p[k:]]))
        out += [(g, i + 1, " ".join(p), -a, x, y, n[g], -s) for i, (s, a, _, p, x, y) in enumerate(sorted(found)[:2000])]
    return sorted(out)


@pytest.mark.parametrize("step, partitions", [(1 << 22, 8), (200, 61)])
def test_collocations_are_exact(spark, empty, monkeypatch, step, partitions):
    """The same phrases whether texts are counted whole or in small blocks, and wherever the sorted streams are split."""
    monkeypatch.setattr(phrases, "STEP", step)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = random.Random(6)
        words = ["a", "b", "É", "New", "york", "City", "日本", "-", "x\x00y", "of"]
        text = lambda n: "".join(r.choice(["a ", "a ", "new york city ", "new york "] + [w + r.choice([" ", "\t", "  ", ", ", ".\n"]) for w in words]) for _ in range(n))
        rows = [(i, text(r.randrange(40)), r.choice(["en", "de", None, ""])) for i in range(400)] + [(500, None, "en"), (501, "", None), (502, " \t\n.", "xx"), (None, "one two", "en")] + [(503, "same old words here", "fr")] * 25 + [(504, "long run " * 4000, "en")]
        got = phrases.collocations(frame(spark, rows))
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        want = collocations_brute(rows)
        assert sorted(map(tuple, got.collect())) == want and len(want) > 60
        assert phrases.collocations(empty).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_collocation_scores_pass_64_bits(spark):
    """Counts of 10^12: the products have 30 digits, the score is exact."""
    f, x, y = 999_999_999_989, 1_999_999_999_973, 1_000_000_000_039
    row = spark.createDataFrame([(f, x, y)], "f long, l long, r long").select(phrases._score("l", "r").alias("s")).first()
    assert row["s"] == 10**6 * f * f // (x * y)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))


def test_token_counts_equal_library(spark, empty, library):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    texts = [None, "", " ", "x", "don't  stop\t\n\n now.", "a" * 200_000, "<|endoftext|>a<|endoftext|>", "é ß 日本語 🎉 12 345!?", "word " * 600, "\x00  　 x", "<|endof text|>"]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(3, "x", "en"), (None, "two words", None)]
    got = heapcount.token_counts(frame(spark, rows), path)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, len((t or "").encode()), n(t), n(t) > 512) for i, t, _ in rows), key=repr)
    assert heapcount.token_counts(empty, path).count() == 0


def test_tokens_lie_across_no_cut(library):
    """Texts of blanks, marks, letters and white space of all kinds, cut after few bytes, count as the whole does."""
    counter, r = heapcount.HeapCounter(queries.tokenizer_path("byte_bpe_50k.json")), random.Random(3)
    bits = ["a", "b", " ", "\n", "  ", "\t", "é", "日本", " ", "　", " ", "\u0085", ".", ",", "!", "'s", "<|endoftext|>", "🎉", "12", "the", "ing", "\x00", "ⓐ", "ï", "̃"]
    for _ in range(60):
        texts = ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(50)] + [None]
        data, offsets = utf8(pa.array(texts))
        total = np.zeros(len(texts), np.int64)
        for part, starts in heapcount.parts(data, offsets, r.choice([5, 17, 100, 1 << 20])):
            total += np.bincount(np.searchsorted(offsets, starts, side="right") - 1, counter.counts(part), len(texts)).astype(np.int64)
        assert total.tolist() == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_windows_of_items_without_id(spark, monkeypatch):
    """Items of 1 to 12 words, some without id: the rows of the SQL, sent to all tasks or not, from one reading."""
    r = random.Random(9)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(6))
    items = [(k, " ".join(word() for _ in range(1 + k % 12))) for k in range(36)] + [(None, " ".join(word() for _ in range(n))) for n in (1, 4, 12)] + [(7, "a1 b2")]
    rows = [(i, " ".join(word() for _ in range(r.randrange(120)))) for i in range(60)] + [(100, items[-2][1]), (101, None), (102, items[11][1] + " " + items[11][1])]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows]}))
    con.register("benchmark", pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": [t for _, t in items]}))
    rel = con.sql(sql.OP4)
    at = [rel.columns.index(c) for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")]
    want = sorted(tuple(x[k] for k in at) for x in rel.fetchall())
    sent = decontaminate.report(documents, benchmark)
    assert sorted(map(tuple, sent.collect())) == want
    clean = sorted(x[0] for x in want if not x[5])
    assert sorted(x["doc_id"] for x in decontaminate.remove_documents(documents, benchmark).collect()) == clean
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    shuffled = decontaminate.report(documents, benchmark)
    assert sorted(map(tuple, shuffled.collect())) == want


def test_windows_are_read_from_texts_once(spark, tmp_path):
    path = str(tmp_path / "documents")
    spark.createDataFrame([(1, "a b c d e f g h i j k l")], "doc_id long, text string").write.parquet(path)
    bench = spark.createDataFrame([(n, " ".join("abcdefghijkl"[:n])) for n in range(1, 13)], "item_id long, text string")
    plan = decontaminate.report(spark.read.parquet(path), bench)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id") == 1


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_equal_pages_are_all_written(spark, tmp_path, monkeypatch, broadcast):
    """A third of all rows is one page, in many files, and other pages have equal rows too: every row comes back."""
    monkeypatch.setattr(warc, "EQUAL_ROWS", 50)
    long = "<p>" + "w" * 120
    rows = [(i, f"http://h/{i}", long + str(i % 40)) for i in range(400)] + [(7, "http://h/7", long + "7")] * 200 + [(7, "http://other/7", long + "7")] * 3 + [(90, None, None)] * 5 + [(None, "u", long + "7")] * 4 + [(47, "http://h/47", long + "7")] * 2
    path = str(tmp_path / "pages")
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(16).write.parquet(path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = collections.Counter(map(tuple, warc.page_transactions(spark.read.parquet(path)).select("page_id", "payload_bytes", "record_type", "refers_to").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h, i)
    want = collections.Counter((i, len(h or ""), *(("response", None) if len(h or "") < 100 or first[h] == i else ("revisit", first[h]))) for i, _, h in rows)
    assert got == want
