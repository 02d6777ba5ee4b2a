"""Fitted models against plain computations on collected rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import language, quality
from quirefold.llm.common import ship

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def monotone(y, w):
    """Isotonic levels by the max-min formula."""
    mean = lambda a, b: np.average(y[a : b + 1], weights=w[a : b + 1])
    n = len(y)
    return np.array([max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


def test_quality_is_ridge_regression_and_isotonic_levels(spark):
    """Weights from all rows at once, cross-fitted raw scores, their levels by definition: the scores of Spark's sums."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", F.col("quality").alias("label")).dropDuplicates(["doc_id"])
    stats = quality.with_statistics(docs, ["doc_id"]).join(labels, "doc_id").withColumn("fold", F.col("doc_id").cast("int") % 4).cache()
    rows = stats.orderBy("doc_id").collect()
    x, y, fold = np.array([r["stats"] for r in rows]), np.array([float(r["label"]) for r in rows]), np.array([r["fold"] for r in rows])
    mean, deviation = x.mean(0), x.std(0)
    deviation[deviation < 1e-9] = 1
    phi = quality.features(x, mean, deviation)
    penalty = quality.PENALTY * np.diag([0.0] + [1.0] * quality.FEATURES) + 1e-9 * np.eye(quality.FEATURES + 1)
    ridge = lambda rows: np.linalg.solve(phi[rows].T @ phi[rows] + penalty, phi[rows].T @ y[rows])
    raw = np.array([phi[i] @ ridge(fold != fold[i]) for i in range(len(y))])
    low, high = quality.RANGE
    bins = np.clip((raw - low) / (high - low) * quality.BINS, 0, quality.BINS - 1).astype(int)
    each = sorted(set(bins.tolist()))
    level = monotone(np.array([y[bins == b].mean() for b in each]), np.array([(bins == b).sum() for b in each]))
    centre = np.array([raw[bins == b].mean() for b in each])
    # Bins of one level are one pool at their common centre.
    pools = sorted({round(v, 12) for v in level})
    knots = np.array([np.average(centre[np.isclose(level, v)], weights=[(bins == b).sum() for b, same in zip(each, np.isclose(level, v)) if same]) for v in pools])
    want = np.interp(phi @ ridge(np.ones(len(y), bool)), knots, pools)
    got = {r["doc_id"]: r["score"] for r in quality.score(stats, quality.fit(stats), ["doc_id"]).collect()}
    assert [got[r["doc_id"]] for r in rows] == pytest.approx(want.tolist(), abs=1e-6)


def test_statistics_of_odd_texts(spark):
    """Null, empty, repeated and very long texts have finite statistics; equal texts equal ones; repeated rows stay."""
    long = "word " * 200_000 + "end\n"
    rows = [(1, None), (2, ""), (3, long), (4, "A b b.\nA b b."), (4, "A b b.\nA b b."), (5, "A b b.\nA b b."), (None, "日本 語")]
    found = quality.with_statistics(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()
    assert len(found) == len(rows) and all(np.isfinite(r["stats"]).all() for r in found)
    by = dict(zip(quality.STATISTICS, next(r["stats"] for r in found if r["doc_id"] == 5)))
    assert by["log_words"] == pytest.approx(math.log1p(6)) and by["distinct_words"] == pytest.approx(3 / 6) and by["repeated_lines"] == pytest.approx(1 / 2) and by["upper"] == pytest.approx(2 / 13)
    same = [r["stats"] for r in found if r["doc_id"] in (4, 5)]
    assert same[0] == same[1] == same[2] and found[0]["stats"] != same[0]


def test_a_document_labelled_twice_teaches_twice(spark):
    stats = quality.with_statistics(spark.createDataFrame([(i, "w " * (i + 1)) for i in range(40)], "doc_id long, text string"), ["doc_id"])
    labels = spark.createDataFrame([(i, int(i > 20)) for i in range(40)] + [(39, 1)], "doc_id long, label int")
    model = quality.fit(stats.join(labels, "doc_id").withColumn("fold", F.col("doc_id").cast("int") % 4))
    assert model.rows == 41


def test_language_is_that_of_fewest_bytes(spark):
    """Every text compressed with every dictionary, block by block, apart from the operator's code."""
    import zstandard

    r = random.Random(4)
    letters = {"aa": "abcdefg", "bb": "hijklmn", "cc": "abhinop"}
    words = {g: ["".join(r.choice(c) for _ in range(r.randrange(2, 9))) for _ in range(300)] for g, c in letters.items()}
    text = lambda g, n: " ".join(r.choice(words[g]) for _ in range(n))
    taught = spark.createDataFrame([(text(g, 200), g) for g in letters for _ in range(30)] + [(None, "aa"), ("text", None), ("...", "bb")], "text string, lang string")
    dictionaries = language.fit(taught)
    rows = [(i, text(g, r.randrange(1, 400))) for i, g in enumerate(list(letters) * 12)] + [(90, None), (91, ""), (92, "12 ..."), (93, "zz"), (94, text("aa", 50_000)), (95, text("aa", 60) + " " + text("bb", 60))]
    size = lambda t, d: sum(len(zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False).compress(t[i : i + language.BLOCK_BYTES])) for i in range(0, len(t), language.BLOCK_BYTES))
    got = {x["doc_id"]: x for x in language.classify(spark.createDataFrame(rows, "doc_id long, text string"), dictionaries).collect()}
    for i, t in rows:
        if not any(c.isalpha() for c in t or ""):
            assert (got[i]["lang_pred"], got[i]["lang_score"], got[i]["lang_accepted"]) == ("und", 0.0, False)
        elif len(t) < 20_000:
            sizes = [(size(t.lower().encode(), d), k) for k, d in enumerate(dictionaries.values())]
            assert got[i]["lang_pred"] == list(dictionaries)[min(sizes)[1]], i
    assert got[94]["lang_pred"] == "aa" and got[94]["lang_accepted"]


def test_pattern_graph_is_scored_until_nothing_is_added(spark):
    """Seeds, patterns and instances at random, against loops over the definition; several rounds add something."""
    from quirefold.llm import pii

    r = random.Random(12)
    rows = []
    for kind in range(2):
        for layer in range(4):
            # A layer's patterns stand beside its own instances and some of the layer before.
            for pattern in range(4):
                for _ in range(14):
                    of = max(0, layer - (r.random() < 0.8))
                    rows.append((len(rows), kind, f"i{kind}-{of}-{r.randrange(7)}", of == 0, [f"p{layer}-{pattern}", f"q{r.randrange(3)}"][: r.randrange(1, 3)]))
    rows += [(len(rows) + i, 0, f"lone{i}", False, ["rare"]) for i in range(9)] + [(len(rows) + 20, 1, "none", False, [])]
    found = spark.createDataFrame(rows, "row long, kind int, instance string, seed boolean, patterns array<string>")
    beside = {}
    for _, k, i, _, patterns in rows:
        for p in patterns:
            beside.setdefault((k, p), set()).add((k, i))
    seeds = {(k, i) for _, k, i, s, patterns in rows if s and patterns}
    believed, rounds = set(seeds), 0
    while True:
        sure = [v for v in beside.values() if len(v & believed) >= pii.SUPPORT and len(v & believed) >= pii.CONFIDENCE * len(v)]
        new = seeds.union(*sure) if sure else set(seeds)
        if len(new) == len(believed):
            break
        believed, rounds = new, rounds + 1
    got = {(x["kind"], x["instance"]) for x in pii.confident_instances(found).collect()}
    assert got == believed and rounds >= 1 and len(seeds) < len(believed)
