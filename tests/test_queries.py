"""Registered queries on the smallest tables: every one has rows with unique column names; some equal their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CHECKED = ["T1_normalize_whitespace", "T6_coalesce_lines", "T8_split_long_paragraph", "K3_context_budget", "R3_rank_blocks", "C9_pack_context", "Q1_pair_messages", "E1_apply_edits", "A2_chunk_by_budget", "X3_build_markdown", "V3_fold_deltas_stream", "V5_append_answers", "V7_question_counts", "P5_assign_column"]


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    order = lambda cols, rows: sorted(repr(tuple(r[cols.index(c)] for c in sorted(cols))) for r in rows)
    assert order(df.columns, [tuple(r) for r in df.collect()]) == order(rel.columns, rel.fetchall())


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(q.startswith(("op", "pipeline")) for q in set(entry.queries()) - set(entry.oracle_sql()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
