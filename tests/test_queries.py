"""A sample of registered queries against their SQL twins, and the shape of the registry."""

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = """d8_municipal_labels d9_shares_by_level f2_partition f5_municipality_owner e1_spearman_pooled
e2_auroc_cumulative e5_clustered_bootstrap e20_targeting_cells e22_targeting_national c9_chebyshev_neighbours
d1_optical_composite c4_point_in_polygon c7_nearest_site a1_read_tracts g5_scored_tokens""".split()


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_twin(spark, name):
    _, problems = compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name])
    assert [p for p in problems if p != "EMPTY"] == []


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_four_budgets(spark):
    assert entry.entry(spark).count() == 4
