"""Training-data operators against plain versions, on small hand-made and given tables."""

import collections
import hashlib
import math
import random
import re
import zlib
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from context_tree import ContextTree
from quirefold.llm import bpe, components, ctw, decontaminate, jaccard, language, orderhash, pii, quality, queries, shingles, sql, token_files, warc
from quirefold.llm.common import ship

SMALL, LESS = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, spans string, score string, lang_pred string"
WORDS = "the of and reon thtion ered nthan leau ouai ment".split()


def sentence(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


TEXTS = [None, "", "  \n ", "x", "Ab aB.", sentence(1, 40), sentence(1, 40), sentence(1, 39) + " end", sentence(2, 300), "a" * 200_000, "é ß 日本語 🎉 <|endoftext|> don't  a\t\tb\n\nc", "... !!! 12 345"]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def docs(spark):
    """Null, empty, very long and repeated texts, a null id, and columns whose names the operators use."""
    rows = [(i, t, "en", "s", len(t or ""), "x", "x", "x", "x") for i, t in enumerate(TEXTS)] + [(None, sentence(5, 20), None, None, None, "x", "x", "x", "x"), (3, "x", "en", "s", 1, "x", "x", "x", "x")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name, text", [("op1_warc", sql.OP1), ("op4_decontaminate", sql.OP4), ("op9_jaccard", sql.OP9), ("op11_lexical_search", sql.OP11), ("op12_collocations", sql.OP12)])
def test_equals_sql(spark, name, text):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SMALL)
    rel = con.sql(text)
    order = lambda cols, rows: sorted(repr(tuple(r[cols.index(c)] for c in sorted(cols))) for r in rows)
    assert order(df.columns, [tuple(r) for r in df.collect()]) == order(rel.columns, rel.fetchall())


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path(name))


def test_bpe_equals_library(docs, empty):
    path, tok = queries.tokenizer_path("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    got = sorted((r for r in bpe.round_trip(docs, path).collect()), key=repr)
    want = []
    for r in docs.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.round_trip(empty, path).count() == 0
    assert {c: t for c, t in bpe.encode(docs, path).dtypes}["ids"] == "array<int>"


def test_bpe_of_long_texts_part_by_part(docs, monkeypatch):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    rows = lambda: sorted((tuple(r) for r in bpe.round_trip(docs, path).collect()), key=repr)
    whole = rows()
    monkeypatch.setattr(bpe, "STEP", 40)
    monkeypatch.setattr(bpe, "LONG", 60)
    text = "é — two  words\n\nthen <|endoftext|> x. " * 9 + "a" * 90
    parts = [p[0].as_py() for p in bpe.long_parts(np.frombuffer(text.encode(), np.uint8))]
    assert "".join(parts) == text and len(parts) > 5
    counted = library("byte_bpe_50k.json")
    ids = np.array(counted.encode(text, add_special_tokens=False).ids, np.uint16)
    assert bpe._digests(ids, path) == ([hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()], [hashlib.sha256(text.encode()).hexdigest()])
    table = bpe._loaded(path)[1]
    assert np.concatenate([table.ids_of(bpe.cut_before_blanks(p)[0])[0] for p in bpe.long_parts(np.frombuffer(text.encode(), np.uint8))]).tolist() == ids.tolist()
    assert rows() == whole


def test_bpe_pairs_are_those_of_exact_merging():
    pairs = bpe.BytePairs(queries.tokenizer_path("byte_bpe_50k.json"))
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50256, 3000), rng.integers(0, 2000, 3000)
    letters = lambda t: "".join(pairs.letters[x] for x in pairs.token_bytes[t])
    assert [pairs.merge(letters(x) + letters(y)) == [x, y] for x, y in zip(a.tolist(), b.tolist())] == pairs.compatible(a, b).tolist()


def test_token_files_equal_library(spark, docs, empty):
    path, tok = queries.tokenizer_path("word_bpe_49k.json"), library("word_bpe_49k.json")
    got = {(r["doc_id"], r["start"]): r for r in token_files.token_files(docs, path, 1).collect()}
    start = 0
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["text"] or "")):
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        found = got[(r["doc_id"], start)]
        assert (found["n_tokens"], found["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == docs.count() and token_files.token_files(empty, path, 1).count() == 0


def test_elias_fano_selects():
    for n, top in ((1, 1), (5, 3), (1000, 10), (1000, 10**6), (0, 1)):
        values = np.sort(np.random.default_rng(n).integers(0, top, n))
        ef = token_files.EliasFano.of(values)
        for first, last in ((0, n), (n // 3, n // 2), (n // 2, n)):
            assert ef.select(first, last).tolist() == values[first:last].tolist()
        assert n < 100 or ef.n_bytes * 8 < n * (4 + math.log2(top / n + 1))


def test_transactions_are_assembled(spark):
    rows = [
        ("r1", "response", []), ("q1", "request", ["r1"]), ("m1", "metadata", ["q1"]),  # through the request
        ("r2", "revisit", ["q2"]), ("q2", "request", []), ("q3", "request", ["gone"]), ("r1", "response", []),
    ]
    records = spark.createDataFrame([(i, t, c, "u", "d", None, None, None, {"k": "v"} if t == "metadata" else None, None) for i, t, c in rows], warc.RECORD)
    got = {r["capture_id"]: (r["main"] and r["main"]["type"], [q["record_id"] for q in r["requests"] or []], [m["record_id"] for m in r["metadata"] or []]) for r in warc.assemble(records).collect()}
    assert got == {"r1": ("response", ["q1"], ["m1"]), "r2": ("revisit", ["q2"], []), "q3": (None, ["q3"], [])}


def test_pages_with_nulls_and_copies(spark):
    big = "<p>" + "é" * 80
    rows = [(1, "http://a/ b", None), (2, None, ""), (3, "u", big), (5, "u", big), (5, "u", big), (None, "u", big), (4, "u", "x")]
    got = sorted(map(tuple, warc.page_transactions(spark.createDataFrame(rows, "page_id long, url string, html string")).drop("payload_digest").collect()), key=repr)
    n = len(big.encode())
    assert got == sorted([(1, 0, "response", None), (2, 0, "response", None), (3, n, "response", None), (5, n, "revisit", 3), (5, n, "revisit", 3), (None, n, "revisit", 3), (4, 1, "response", None)], key=repr)
    assert warc.page_transactions(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_quality_is_learned(spark, empty):
    found = queries.QUERIES["op2_quality"](spark, LESS).join(spark.read.parquet(f"{LESS}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in found) / len(found) > 0.9
    stats = quality.with_statistics(empty, ["doc_id"])
    assert quality.score(stats, quality.fit(stats.selectExpr("stats", "1 as label", "0 as fold")), ["doc_id"]).count() == 0


def test_isotonic_pools():
    x, y = quality.isotonic(np.arange(5.0), np.array([0.1, 0.5, 0.3, 0.2, 0.9]), np.ones(5))
    assert y.round(3).tolist() == [0.1, 0.333, 0.9] and x.tolist() == [0, 2, 4]


def test_language_is_recognised(spark, docs, empty):
    found = queries.QUERIES["op8_language"](spark, LESS).where("held_out").join(spark.read.parquet(f"{LESS}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.97
    got = language.classify(docs, language.fit(docs))
    assert got.count() == docs.count() and set(docs.columns) < set(got.columns)
    assert {r["lang_pred"] for r in got.where("text is null or not text rlike '\\\\p{L}'").collect()} == {"und"}
    assert language.classify(empty, language.fit(empty)).count() == 0


def test_edited_fingerprints(docs, empty):
    own = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in orderhash.edited_fingerprints(own).collect()}
    texts = [t or "" for t in TEXTS]
    for i, t in enumerate(texts):
        follow, q = texts[(i + 1) % len(texts)], len(t) // 4
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + follow[:q]).encode()).hexdigest()
    assert got[5]["fingerprint"] == got[6]["fingerprint"] and got[5]["near_next"] == 1 and got[6]["near_next"] > 0.6
    assert got[8]["near_edited"] > got[8]["near_next"] == 0
    assert orderhash.edited_fingerprints(docs).count() == docs.count() and orderhash.edited_fingerprints(empty).count() == 0


def test_order_counts(spark):
    a, b = sentence(8, 200).split(), sentence(9, 200).split()
    df = spark.createDataFrame([(" ".join(a + b), " ".join(b + a))], "x string, y string")
    d = orderhash.with_fingerprint(orderhash.with_fingerprint(df, "x", "p"), "y", "q").select(orderhash.likeness(F.col("p"), F.col("q"))).first()[0]
    assert 0.2 < d < 0.8  # the same k-mers but few, in another order


def test_insertions_into_runs_without_blanks(spark):
    """One character more changes the k-mers around it only: Chinese, and letters and digits without any blank."""
    r = random.Random(5)
    han, code = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(600)), "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(3000))
    df = spark.createDataFrame([(t, t[:5] + "新x"[k] + t[5:]) for k, t in enumerate((han, code))], "x string, y string")
    d = orderhash.with_fingerprint(orderhash.with_fingerprint(df, "x", "p"), "y", "q").select(orderhash.likeness(F.col("p"), F.col("q")).alias("d")).collect()
    assert all(x["d"] > 0.8 for x in d)


def brute_fingerprint(text):
    """The words of each k-mer kept: the least hashes need Spark, so only which k-mers exist, and how often, is told."""
    w = re.findall(r"\S+", text)
    return collections.Counter(tuple(w[i : i + orderhash.KMER]) for i in range(max(1, len(w) - orderhash.KMER + 1))) if w else collections.Counter()


def test_fingerprints_rest_on_occurrence_numbered_k_mers(spark):
    """Texts of the same k-mers, as often and in the same order, have equal fingerprints; one more occurrence changes what
    is compared, and texts without a common k-mer agree in no range."""
    a, b = sentence(21, 120), sentence(22, 120)
    assert not brute_fingerprint(a) & brute_fingerprint(b) and brute_fingerprint(a + " " + a) != brute_fingerprint(a)
    rows = [(a, "  " + a.replace(" ", "\n\t")), (a, b), (a, a + " " + a), ("", " "), ("one two", "one two"), ("one two", "two one")]
    df = spark.createDataFrame(rows, "x string, y string")
    got = [r["d"] for r in orderhash.with_fingerprint(orderhash.with_fingerprint(df, "x", "p"), "y", "q").select(orderhash.likeness(F.col("p"), F.col("q")).alias("d")).collect()]
    assert got[0] == 1 and got[1] == 0 and 0 < got[2] < 1 and got[3:] == [1, 1, 0]


def test_decontamination_cuts_and_removes(spark, docs, empty):
    item = sentence(2, 300).split()
    bench = spark.createDataFrame([(1, " ".join(item[20:45]), 0), (2, "X", 0), (3, None, 0), (4, "", 0)], "item_id long, text string, extra int")
    got = {r["doc_id"]: r for r in decontaminate.report(docs, bench).collect()}
    assert (got[8]["n_hit"], got[8]["n_items"]) == (25, 1) and got[3]["contaminated"] and not got[5]["contaminated"]
    assert sorted(r["doc_id"] for r in decontaminate.remove_documents(docs, bench).where("doc_id is not null").collect()) == [0, 1, 2, 4, 5, 6, 7, 9, 10, 11]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench).collect()}
    assert cut[8] == " ".join(item[:20] + item[45:]) and cut[5] == TEXTS[5] and cut[0] is None
    assert decontaminate.report(empty, bench).count() == 0 and decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_personal_data_base_form():
    r = random.Random(7)
    forms = {k: re.compile(p) for k, p in zip(pii.KINDS, (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))}

    def keep(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")), "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    for _ in range(4000):
        text = "".join(r.choice("a1@.+- 4(é") for _ in range(r.randrange(60)))
        assert pii.base_spans(text) == [(k, *m.span()) for k, kind in enumerate(pii.KINDS) for m in forms[kind].finditer(text) if keep(kind, m.group())], text


def test_personal_data_bootstraps(spark, docs, empty):
    rows = [(i, f"please call me now +1 (555) 555-{1000 + i} thanks a lot") for i in range(8)] + [(20, "please call me now 555-123-4567 thanks a lot"), (21, "order number list 555-123-4568 of parts")]
    got = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[20]["spans"] == "phone:19:31" and got[20]["n_phone"] == 0 and got[21]["spans"] == "" and got[0]["n_phone"] == 1
    red = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert red[0] == "please call me now <PHONE> thanks a lot" and red[21] == rows[-1][1]
    assert pii.report(docs).count() == docs.count() == pii.redact(docs).count() and pii.report(empty).count() == 0


def test_language_model(spark, docs, empty):
    got = ctw.scores(docs, F.col("doc_id") != 8).collect()
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None]
    seen = collections.Counter(t for r in docs.collect() if r["doc_id"] not in (8, None) for t in tokens(r["text"]))
    total = sum(seen.values())
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        own = tokens(text[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(seen[t] > 0 for t in own), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((seen[t] + 0.1) / (total + 0.1 * (len(seen) + 1))) for t in own))
    assert len(got) == docs.count() and ctw.scores(empty, F.lit(True)).count() == 0


def test_context_tree_is_a_distribution():
    tree = ContextTree(["abracadabra" * 50], ctw.DEPTH)
    context = b"rabra"[-ctw.DEPTH :]
    assert sum(10 ** tree.log10(context, byte) for byte in range(256)) == pytest.approx(1)
    # A tree of the root alone: weighting cannot change the estimate.
    assert ContextTree(["aa"], 0).log10(b"", 97) == pytest.approx(math.log10(3.5 / 4) + math.log10(2.5 / 4) + 6 * math.log10(2.5 / 3))


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}
    for _ in range(80):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root[x] for x in root if any(x in e and e[0] != e[1] for e in edges)}


def test_jaccard_loses_no_link(spark, docs, empty):
    r = random.Random(3)
    rows = []
    for family in range(12):
        base = sentence(100 + family, r.choice([3, 5, 30, 80]))
        for _ in range(10):
            w = base.split()
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = f"new{r.randrange(9)}"
            rows.append((len(rows), " ".join(w)))
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)}
    root = {i: i for i in sets}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in range(40):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}
    edge = jaccard.classes(docs, 4, 85)
    assert edge.count() == docs.count() and {x["component_id"] for x in edge.where("doc_id in (5, 6)").collect()} == {5}
    assert jaccard.classes(empty, 4, 85).count() == 0


@pytest.mark.parametrize("cache", [0, 40, 1 << 21])
def test_language_model_keeps_every_context(spark, docs, monkeypatch, cache):
    """Scores are those of the tree of all contexts, also of one seen once among many bytes, whatever is held in tasks."""
    monkeypatch.setattr(ctw, "CACHE", cache)
    monkeypatch.setattr(ctw, "COMMON", 10)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None] + [(100, "qzxwv jkpyf"), (101, "qzxwv jkpyf"), (102, "never seen #~")]
    held = (8, 101, 102)
    got = {r["doc_id"]: r for r in ctw.scores(spark.createDataFrame(rows, "doc_id long, text string"), ~F.col("doc_id").isin(*held)).collect()}
    tree = ContextTree([t for i, t in rows if i not in held], ctw.DEPTH)
    for i, t in rows:
        assert got[i]["score"] == pytest.approx(tree.score(t), rel=1e-4, abs=1e-4), i


def test_long_texts_are_taken_part_by_part(spark, monkeypatch):
    """The scores of a text do not depend on how much of it a step takes."""
    text = sentence(3, 3000)
    frame = spark.createDataFrame([(1, text), (2, text[:5000]), (3, "short one")], "doc_id long, text string")
    run = lambda: {r["doc_id"]: r for r in ctw.scores(frame, F.col("doc_id") == 1).collect()}
    whole = run()
    monkeypatch.setattr(ctw, "STEP", 700)
    monkeypatch.setattr(ctw, "CACHE", 50)
    parts = run()
    for i, r in whole.items():
        assert parts[i]["score"] == pytest.approx(r["score"], rel=1e-9) and parts[i]["base_score"] == pytest.approx(r["base_score"], rel=1e-9) and parts[i]["n_known"] == r["n_known"]
    data = np.frombuffer(text.encode(), np.uint8)
    monkeypatch.setattr(shingles, "LONG", 100)
    assert shingles.word_hashes(data, np.array([0, len(data)]))[0].tolist() == shingles._hashed(data, np.array([0, len(data)]))[0].tolist()


def test_personal_data_goes_on_from_what_it_found(spark):
    """A context beside five found numbers, but no strict one, adds the sixth; and any form in a sure slot is found."""
    near = lambda i, x: (i, f"please call me now {x} thanks a lot")
    rows = [near(i, f"+1 (555) 555-{1000 + i}") for i in range(40)] + [near(100 + i, f"555-123-456{i}") for i in range(5)]
    rows += [(200 + i, f"reach her under 555-123-456{i} any day") for i in range(5)] + [(210, "reach her under 555-999-0000 any day"), (211, "parts list 555-999-0001 of box")]
    rows += [near(220, "5559876543")]
    for n, (word, strict) in enumerate((("mail", lambda i: f"a{i}@b.org"), ("host", lambda i: f"10.0.0.{i}"), ("paid", lambda i: next(c for d in range(10) if pii.luhn((c := f"41111111111{i:04d}{d}")))))):
        rows += [(1000 + 100 * n + i, f"the {word} is {strict(i)} {word} ends here") for i in range(40)]
    other = {300: ("mail", "jo.doe at host dot com", "email"), 301: ("host", "2001:db8::7", "ip"), 302: ("paid", "41111 11111 111112", "card")}
    rows += [(i, f"the {word} is {x} {word} ends here") for i, (word, x, _) in other.items()] + [(310, "we met at two dot com fairs in 41111 11111 111112 days")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[210] == "phone:16:28" and got[211] == "" and got[220] == "phone:19:29"
    for i, (_, x, kind) in other.items():
        assert got[i] == f"{kind}:12:{12 + len(x)}", i


def test_language_ties_are_rejected_and_every_sample_teaches(spark):
    assert not language.decide([51, 51, 51], ["a", "b", "c"])[2] and language.decide([50, 51, 51], ["a", "b", "c"])[2]
    assert not language.decide([1064, 1073], ["a", "b"])[2] and language.decide([1064, 1074], ["a", "b"])[2]
    rows = [(chr(0x4E00 + i) * 2000, "zh") for i in range(language.SAMPLE_TEXTS)]
    (d,) = language.fit(spark.createDataFrame(rows, "text string, lang string")).values()
    assert len(d) <= language.DICTIONARY_BYTES and set(d.decode()) - {"\n"} == {t[0] for t, _ in rows}
