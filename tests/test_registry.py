"""A few registered queries against their SQL at the smallest scale; ALL_QUERIES=1 runs all of them."""

import os

import pytest

from clearcharge.registry import all_queries
from tests import oracle

FOLDER = "/root/testdata/sf0.001"
FEW = ("P4_money", "P39_tokens", "P40_parse_query", "J1_locate_hospitals", "D1_summarise", "D11_W8_scan_plan", "R6_run_status", "S10_W7_parse_index")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", list(all_queries()[0]) if os.environ.get("ALL_QUERIES") else FEW)
def test_query_equals_its_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(FOLDER), FOLDER, name) in (None, "EMPTY")


def test_every_oracle_belongs_to_a_query():
    queries, oracles = all_queries()
    assert set(oracles) <= set(queries) and not [n for n in queries if n.startswith("op")]
