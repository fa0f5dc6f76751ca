"""Every registered catalog query against its DuckDB equivalent."""

import pytest
from conftest import DATA, compare

from quarrymill.plans.registry import ORACLES, QUERIES

#: Seeded k-means and what is built on it; tested against brute force in test_golden.py.
WITHOUT_SQL = {"V10_A28_centroids", "D01_sweep", "D02_sweeps"}


def test_all_others_have_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    compare(QUERIES[name](spark, DATA), duck, ORACLES[name])
