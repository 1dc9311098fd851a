"""Registered queries: a sample runs against its oracle on the smallest tables (all of them: tools/check_oracle.py)."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, norm

SF = "/root/testdata/sf0.001"
SAMPLE = ["c13_state", "c04_duplicate_tool_calls_last_3", "c21_late_events", "d5a_trajectory_analysis", "f1_idempotent_ingest",
          "e5_anchor_rescue", "h19_route_decision", "k3_candidate_metrics", "j1_tfidf_weights", "e11_contrastive_pairs"]


def test_names_match():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) >= 140


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert sorted(names) == cols and got == want
