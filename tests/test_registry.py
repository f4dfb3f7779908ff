"""Every registered query against its SQL on the small tables."""

import pytest

import check
from clanmark.registry import load

FOLDER = "/root/testdata/sf0.001"
BASE = load()


@pytest.fixture(scope="module")
def con():
    return check.database(FOLDER)


def test_every_query_has_sql():
    assert set(BASE.QUERIES) == set(BASE.ORACLES) and len(BASE.QUERIES) >= 120


@pytest.mark.parametrize("name", list(BASE.QUERIES))
def test_query(spark, con, name):
    result = check.compare(spark, con, FOLDER, name, BASE)
    assert result.startswith("ok"), result
