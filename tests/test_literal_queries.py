"""Queries over literal rows against their SQL, in one session."""

import duckdb
import pytest

from corpusloom.plans.registry import ORACLES, QUERIES

NAMES = """status_findings 
snapshot_faults talk_records account_verdicts 
slide_keys deck_slides page_rows marked_verses """.split()


def key(row):
    return tuple("" if x is None else str(x) for x in row)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, name):
    got = QUERIES[name](spark, "/nowhere")
    columns = sorted(got.columns)
    want = duckdb.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert sorted(key(r) for r in got.select(*columns).collect()) == sorted(key([r[i] for i in places]) for r in want.fetchall())


def test_every_name_has_one_query():
    assert set(ORACLES) <= set(QUERIES)
