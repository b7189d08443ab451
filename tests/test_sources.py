"""Sources on executors that are processes of their own."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest
from conftest import hollow_folder

REPO = Path(__file__).resolve().parent.parent

_ON_A_CLUSTER = """
import json, sys
from tesseral.queries.dialect import QUERIES
from tesseral.session import get_session

spark = get_session("sources", "local-cluster[2,1,1024]", spark__ui__enabled="false", spark__driver__host="127.0.0.1")
df = QUERIES["source_jdbc"](spark, sys.argv[1])
print("ROWS", json.dumps([df.dtypes, df.rdd.getNumPartitions(), sorted(map(tuple, df.collect()))]))
spark.stop()
"""


def test_jdbc_between_processes(tmp_path):
    """Three ranges read by two executors, neither of which is the driver."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    # keys beyond the ranges' bounds on both sides, texts with quotes, blanks and letters of two scripts
    want = [[k, f" it's \"{k}\" é日 "] for k in range(-5, 2500)] + [[9000, ""]]
    schema = pq.read_schema("/root/testdata/sf0.001/nation.parquet")
    kinds = [schema.field(c).type for c in ("n_nationkey", "n_name")]
    pq.write_table(pa.table({c: pa.array(v, t) for c, v, t in zip(("n_nationkey", "n_name"), zip(*want), kinds)}), tmp_path / "nation.parquet")

    home = tmp_path / "home"  # executors write their logs to Spark's home
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))}
    env |= {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": str(REPO), "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", _ON_A_CLUSTER, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    said = [x for x in run.stdout.splitlines() if x.startswith("ROWS ")]
    assert said, run.stderr[-3000:]
    assert json.loads(said[0][5:]) == [[["n_nationkey", "int"], ["n_name", "string"]], 3, want]


@pytest.mark.parametrize("n", [0, 3])
def test_jdbc_hollow(spark, tmp_path, n):
    from tesseral.queries.dialect import QUERIES

    assert [tuple(r) for r in QUERIES["source_jdbc"](spark, hollow_folder(tmp_path, n)).collect()] == [(None, None)] * n


def test_jdbc_keeps_long_texts(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tesseral.queries.dialect import QUERIES

    want = [(0, "x" + " " * 70), (1, "é" * 65), (2, "y" * 100_000)]
    pq.write_table(pa.table({"n_nationkey": pa.array([k for k, _ in want], pa.int32()), "n_name": [v for _, v in want]}), tmp_path / "nation.parquet")
    assert sorted(map(tuple, QUERIES["source_jdbc"](spark, str(tmp_path)).collect())) == want
