"""The corpus pipeline: each stage keeps the columns of documents, its decisions take effect, clean documents stay."""

import corpus_pipeline as p
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    extra = [(90001, None), (90002, ""), (90003, "12 34"), (90004, "Write to someone.else@example.com soon about the rest of this and that"), (90005, f"Before that there were words. {item} And after it more of them.")]
    added = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in extra], docs.schema)
    copy = docs.where("length(text) > 200").orderBy("doc_id").limit(1).withColumn("doc_id", F.lit(90006).cast("long"))
    docs = docs.unionByName(added).unionByName(copy)
    seen = []
    for name, stage in p.STAGES[:-1]:
        after = p.stored(stage(spark, docs, SF), "stage")
        assert after.columns == docs.columns
        ids = {r[0] for r in after.select("doc_id").collect()}
        assert ids <= {r[0] for r in docs.select("doc_id").collect()}
        seen.append(ids)
        docs = after
    assert not seen[0] & {90001, 90002, 90003} and 90005 in seen[0] and 90006 in seen[0]
    assert len(seen[0]) >= 195 and 90006 not in seen[1]
    assert 90005 not in seen[2] and 90004 in seen[3] and seen[3] == seen[2]
    row = docs.where("doc_id = 90004").first()
    assert "<EMAIL>" in row["text"] and row["n_chars"] == len(row["text"])
    last = p.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in last} == seen[3] and all(r["n_tokens"] == len(r["ids"]) > 0 for r in last)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_odd_rows_pass_all_stages(spark):
    """Columns named as the operators name theirs, a very long text, repeated ids and rows, and an item without id."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 300 and lang = 'en'").orderBy("doc_id").limit(40)
    clean = p.stored(p.decontamination(spark, p.near_duplicates(spark, p.language_id(spark, docs, SF), SF), SF), "clean").orderBy("doc_id").collect()
    first, others = clean[0], " ".join(r["text"].replace("@", " ") for r in clean[1:])
    ending = " and here it ends, mail to some.one@example.org now"
    made = [(first["doc_id"], first["text"]), (first["doc_id"], first["text"]), (None, first["text"]), (80001, others * 12 + ending)] + [(r["doc_id"], r["text"]) for r in clean[1:12]]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in made], docs.schema)
    for name in ("ids", "lang_pred", "lang_score", "spans", "text_hash", "component_id", "row", "w", "h", "rep", "n_hit"):
        rows = rows.withColumn(name, F.lit("own"))
    rows = p.stored(rows, "odd")
    n = rows.count()
    for name, stage in p.STAGES[:-1]:
        after = p.stored(stage(spark, rows, SF), "stage")
        assert after.columns == rows.columns and after.count() <= n, name
        rows, n = after, after.count()
    kept = {r["doc_id"]: r for r in rows.collect()}
    assert first["doc_id"] in kept and 80001 in kept and kept[80001]["text"].endswith("mail to <EMAIL> now") and kept[80001]["spans"] == "own"
    assert rows.where(F.col("doc_id") == first["doc_id"]).count() == 2
    last = {r["doc_id"]: r for r in p.STAGES[-1][1](spark, rows, SF).collect()}
    assert set(last) == set(kept) and last[80001]["n_tokens"] > 100_000
