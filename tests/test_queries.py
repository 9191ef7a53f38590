"""Registered queries against their SQL at the smallest scale.

Ingest, store and stream queries have their own tests on files; here they would only
repeat them slowly. ``python tests/oracle_check.py`` runs every query.
"""

from __future__ import annotations

import pytest
from oracle_check import connect, difference

import __spark_entry__ as entry
from postpulse.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"
SLOW = ("src_csv", "src_store", "src_api_s", "src_api_b", "snk_", "st_", "txt_topics_lda")
FAST = [name for name in QUERIES if not name.startswith(SLOW)]


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, duck, name):
    mine = entry.queries()[name](spark, SF_DIR).toPandas()
    assert difference(mine, duck.execute(entry.oracle_sql()[name]).df()) is None


def test_every_query_but_lda_has_sql():
    assert set(QUERIES) - set(entry.oracle_sql()) == {"txt_topics_lda"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == [
        "topic", "crisis_posts", "total_posts", "crisis_score", "alert_level"]
