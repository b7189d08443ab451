import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tesseral.session import get_session

    s = get_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture()
def engine(spark, tmp_path):
    from tesseral.session import Engine

    for v in spark.catalog.listTables():
        spark.catalog.dropTempView(v.name)
    return Engine(spark, store=str(tmp_path / "store"))


def rows(df, *order):
    """Rows as tuples, sorted with nulls first."""
    key = lambda r: tuple((x is not None, str(type(x)) if isinstance(x, (list, dict)) else "", x if not isinstance(x, (list, dict)) else str(x)) for x in r)
    return sorted((tuple(r) for r in df.select(*(order or df.columns)).collect()), key=key)


def hollow_folder(path, n_null_rows):
    """The test tables' schemas with no rows, or with rows of nothing but nulls."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    src = Path("/root/testdata/sf0.001")
    for f in src.glob("*.parquet"):
        schema = pq.read_schema(f).remove_metadata()
        pq.write_table(pa.table([pa.nulls(n_null_rows, t) for t in schema.types], schema=schema), path / f.name)
    return str(path)
