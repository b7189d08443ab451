"""Joins along an axis and sessions against plain versions, over several shards, with nulls, ties and empty tables."""

import random
from datetime import datetime, timedelta

from conftest import rows

from tesseral.operators import patterns
from tesseral.operators.temporal import as_of_join, interval_join

T0 = datetime(2026, 1, 1)


def _times(rng, n, spread):
    return [(rng.choice([1, 1, 2, None]), T0 + timedelta(minutes=rng.randrange(spread)) if rng.random() > 0.1 else None, i) for i in range(n)]


def test_as_of_join(spark):
    rng = random.Random(4)
    left, right = _times(rng, 60, 4000), _times(rng, 40, 4000)
    a, b = spark.createDataFrame(left, "k int, ts timestamp, i int"), spark.createDataFrame(right, "k int, ts timestamp, v int")
    want = []
    for k, t, i in left:
        before = [(s, v) for q, s, v in right if k is not None and q == k and t is not None and s is not None and s <= t]
        want.append((k, t, i, max(before)[1] if before else None))
    for shard in (600, 10**7):
        assert sorted(map(str, map(tuple, as_of_join(a, b, ["k"], "ts", ["v"], shard).collect()))) == sorted(map(str, want))
    assert as_of_join(a.limit(0), b, ["k"], "ts", ["v"]).count() == 0
    assert {r["v"] for r in as_of_join(a, b.limit(0), ["k"], "ts", ["v"]).collect()} == {None}


def test_interval_join(spark):
    rng = random.Random(6)
    points = [(i, rng.choice([None, *range(-40, 400)])) for i in range(120)]
    spans = [(j, a, a + rng.choice([-1, 0, 0, 1, 7, 8, 300])) for j, a in ((j, rng.randrange(-40, 400)) for j in range(50))] + [(90, None, 3), (91, 3, None)]
    got = interval_join(spark.createDataFrame(points, "i int, x long"), spark.createDataFrame(spans, "j int, a long, b long"), "x", "a", "b")
    assert rows(got, "i", "j") == sorted((i, j) for i, x in points for j, a, b in spans if None not in (x, a, b) and a <= x <= b)
    assert interval_join(spark.createDataFrame([], "i int, x long"), spark.createDataFrame([], "j int, a long, b long"), "x", "a", "b").count() == 0


def test_sessions(spark):
    rng = random.Random(9)
    said = _times(rng, 200, 9000)
    want, last = {}, {}
    for k, t, i in sorted(said, key=lambda r: (r[1] is not None, r[1] or T0, r[2])):
        n, at = last.get(k, (0, None))
        new = t is None or at is None or (t - at).total_seconds() > 1800
        last[k] = (n + new, t)
        want[i] = n + new
    df = spark.createDataFrame(said, "k int, ts timestamp, i int")
    for shard in (900, 10**7):
        assert {r["i"]: r["session_no"] for r in patterns.sessions(df, "k", "ts", ["i"], 1800, shard).collect()} == want
    assert patterns.sessions(df.limit(0), "k", "ts", ["i"], 1800).count() == 0
