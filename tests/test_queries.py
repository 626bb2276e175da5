"""Every query of the engine against its SQL."""

import pytest

from lakeloom.plans.queries import ORACLES, QUERIES
from tests.oracle import rows_of_frame, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, name):
    assert rows_of_frame(QUERIES[name](spark, SF)) == rows_of_sql(ORACLES[name], SF)
