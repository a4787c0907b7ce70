"""Every registered query against its SQL, over whole small tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entries
from compare import connect, rows_of

from feedforge.workload import QUERIES, SQL

ROWS_ONLY = {"retrieval_model", "ranking_model", "two_stage_recommendations"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_query_equals_sql(spark, con, sf_dir, name):
    df = entries.queries()[name](spark, sf_dir)
    result = con.sql(entries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(result.columns)
    want = result.fetchall()
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(result.columns, want)


def test_only_models_have_no_sql():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY


def test_probabilities_of_the_ranking_model(spark, sf_dir):
    rows = entries.queries()["ranking_model"](spark, sf_dir).collect()
    assert rows and all(0.0 <= r[f"{a}_prob"] <= 1.0 for r in rows for a in ("click", "like", "share", "follow"))


def test_two_stage_ranks(spark, sf_dir):
    rows = entries.queries()["two_stage_recommendations"](spark, sf_dir).collect()
    by_user = {}
    for r in rows:
        by_user.setdefault(r.user_id, []).append((r["rank"], r.score))
    for ranked in by_user.values():
        ranked.sort()
        assert [rank for rank, _ in ranked] == list(range(1, len(ranked) + 1))
        assert [s for _, s in ranked] == sorted((s for _, s in ranked), reverse=True)


def test_entry(spark):
    assert entries.entry(spark).columns == ["user_id", "item_id", "score", "rank"]
