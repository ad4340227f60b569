"""Every query that SQL can express, against DuckDB."""

from __future__ import annotations

import pytest

from lodeflow import plans
from tests.compare import rows


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, sf, name):
    got = plans.queries()[name](spark, sf).toPandas()
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_only_what_sql_cannot_say_has_none():
    assert set(plans.queries()) - set(plans.oracle_sql()) == {"graph_retrieve_adaptive", "bootstrap_ci", "answer_relevance", "engine_answers"}
