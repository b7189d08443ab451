"""The queries of the general problems on empty tables and on rows of nulls."""

import pytest
from conftest import hollow_folder

from tesseral.queries import problems


@pytest.mark.parametrize("n", [0, 3])
def test_hollow_tables(spark, tmp_path, n):
    d = hollow_folder(tmp_path, n)
    for name, f in problems.QUERIES.items():
        got = f(spark, d).collect()
        if name not in ("p2_report", "p3_change_rates"):
            assert got == [], name
