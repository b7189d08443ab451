"""The corpus queries on empty tables and on rows of nulls."""

import pytest
from conftest import hollow_folder

from tesseral.llm import queries


@pytest.mark.parametrize("n", [0, 3])
def test_hollow_tables(spark, tmp_path, n):
    d = hollow_folder(tmp_path, n)
    for name, f in queries.QUERIES.items():
        got = f(spark, d).collect()
        assert got == [] or n and name in ("p7_ids", "p7_roundtrip", "p7_decoded", "p9_redacted"), name
