"""The general problems against brute force on small inputs full of nulls, ties, repeats and odd columns."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tesseral.operators import grid, hierarchy, references, rolling, satellites, skew


# --- salted joins


def test_salted_join_equals_join(spark):
    rng = random.Random(1)
    left = [(None if i % 50 == 0 else 7 if i % 3 == 0 else rng.randrange(40), i) for i in range(3000)]
    right = [(k, f"v{k}") for k in range(0, 40, 2)] + [(7, "seven"), (None, "none")]
    a, b = spark.createDataFrame(left, "k int, i int"), spark.createDataFrame(right, "k int, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(skew.salted_join(a, b, ["k"], how, salts=8)) == rows(a.join(b, ["k"], how)), how


def test_salted_join_of_empty_tables(spark):
    a, b = spark.createDataFrame([], "k int, i int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert skew.salted_join(a, b, ["k"]).count() == 0
    assert rows(skew.salted_join(spark.createDataFrame([(1, 2)], "k int, i int"), b.where("false"), ["k"], "left_anti")) == [(1, 2)]


def test_heavy_keys_are_few(spark):
    df = spark.range(10000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    assert rows(skew.heavy_keys(df, ["k"], 100)) == [(0,)]


# --- references


def _child(spark, name, data):
    df = spark.createDataFrame(data, "id int, ref int, ts timestamp, period string, child_id string")
    return references.Child(name, df, "id", "ref", "ts")


def test_orphans(spark):
    t = datetime(2026, 1, 5)
    kids = [_child(spark, "a", [(1, 10, t, "x", "y"), (1, 10, t, "x", "y"), (2, 99, t, None, None), (3, None, t, None, None), (None, 99, None, None, None)]), _child(spark, "b", [(1, 98, None, None, None)])]
    parents = [(spark.createDataFrame([(10,), (None,), (10,)], "order_id int"), "order_id"), (spark.createDataFrame([(98,)], "order_id int"), "order_id")]
    assert rows(references.orphan_rows(kids, parents), "child_table", "child_id", "_key") == [("a", None, 99), ("a", 2, 99)]
    assert rows(references.orphan_report(kids, parents), "child_table", "period", "n_references", "n_orphans", "n_orphan_keys") == [("a", None, 1, 1, 1), ("a", "2026-01", 3, 1, 1), ("b", None, 1, 0, 0)]


def test_orphans_without_rows(spark):
    kid = _child(spark, "a", [])
    parents = [(spark.createDataFrame([], "order_id int"), "order_id")]
    assert references.orphan_rows([kid], parents).count() == 0
    assert references.orphan_report([kid], parents).count() == 0
    kid = _child(spark, "a", [(1, 5, None, None, None)])
    assert references.orphan_rows([kid], parents).count() == 1


# --- history


def _history(spark, batches, attributes=("city",)):
    sat = seen = None
    for b in batches:
        new = satellites.tracked(spark.createDataFrame(b, "k int, city string, day date, extra int, hash_diff int"), "k", "day", list(attributes))
        add = satellites.append(sat, seen, new, "k", "day", list(attributes))
        sat = add if sat is None else sat.unionByName(add)
        seen = new if seen is None else seen.unionByName(new)
    return satellites.history(sat, "k", "day", list(attributes)), sat


def _brute_history(statements):
    out = []
    by = defaultdict(set)
    for k, c, d, *_ in statements:
        if k is not None and d is not None:
            by[k].add((d, c))
    for k, s in by.items():
        versions = []
        for d, c in sorted(s, key=lambda x: (x[0], x[1] is not None, x[1] or "")):
            if not versions or versions[-1][0] != c:
                versions.append((c, d))
        for i, (c, d) in enumerate(versions):
            out.append((k, c, d, versions[i + 1][1] if i + 1 < len(versions) else None))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_history_in_any_order_of_batches(spark, seed):
    rng = random.Random(seed)
    data = [(rng.choice([1, 1, 2, 3, None]), rng.choice(["a", "b", "c", None]), None if rng.random() < 0.1 else date(2026, 1, 1) + timedelta(rng.randrange(15)), rng.randrange(9), 0) for _ in range(80)]
    got, sat = _history(spark, [data[:30], data[30:60], data[60:]])
    assert rows(got) == rows(spark.createDataFrame(_brute_history(data), "k int, city string, day date, valid_to date"))
    assert sat.count() == sat.distinct().count()


def test_history_keeps_a_restatement_that_a_late_row_makes_a_change(spark):
    d = lambda n: date(2026, 1, n)
    got, _ = _history(spark, [[(1, "a", d(1), 0, 0), (1, "a", d(9), 0, 0)], [(1, "b", d(5), 0, 0)]])
    assert rows(got) == [(1, "a", d(1), d(5)), (1, "a", d(9), None), (1, "b", d(5), d(9))]


def test_tidy_and_rates(spark):
    df = spark.createDataFrame([("\tDar  el Nasim ",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(satellites.tidy("s")).collect()] == ["dar el nasim", "", None]
    st = spark.createDataFrame([(1, date(2026, 1, i), "x", i) for i in range(1, 6)], "k int, d date, slow string, fast int")
    rates = satellites.change_rates(st, "k", "d", ["slow", "fast"])
    assert dict(map(tuple, rates.collect())) == {"slow": 0.0, "fast": 1.0}
    assert satellites.split_by_rate(rates) == {"rate_0": ["slow"], "rate_2": ["fast"]}
    assert rows(satellites.change_rates(st.limit(0), "k", "d", ["slow"])) == [("slow", None)]


# --- grid


def _pchip(xs, ys, x):
    """A plain version of the monotone cubic, by the usual formulas."""
    n = len(xs)
    h = [xs[i + 1] - xs[i] for i in range(n - 1)]
    m = [(ys[i + 1] - ys[i]) / h[i] for i in range(n - 1)]

    def edge(h0, h1, m0, m1):
        d = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
        sg = lambda v: (v > 0) - (v < 0)
        return 0.0 if sg(d) != sg(m0) else 3 * m0 if sg(m0) != sg(m1) and abs(d) > 3 * abs(m0) else d

    if n == 2:
        d = [m[0], m[0]]
    else:
        d = [edge(h[0], h[1], m[0], m[1])]
        for i in range(1, n - 1):
            w0, w1 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            d.append(0.0 if m[i - 1] * m[i] <= 0 else (w0 + w1) / (w0 / m[i - 1] + w1 / m[i]))
        d.append(edge(h[-1], h[-2], m[-1], m[-2]))
    i = max(k for k in range(n - 1) if xs[k] <= x)
    t = (x - xs[i]) / h[i]
    return (1 + 2 * t) * (1 - t) ** 2 * ys[i] + t * (1 - t) ** 2 * h[i] * d[i] + t * t * (3 - 2 * t) * ys[i + 1] + t * t * (t - 1) * h[i] * d[i + 1]


@pytest.mark.parametrize("shard", [3, 90])
def test_grid_equals_plain_interpolation(spark, shard):
    rng = random.Random(shard)
    data = [(rng.choice([1, 2, 3, None]), date(2026, 1, 1) + timedelta(rng.randrange(70)) if rng.random() > 0.05 else None, rng.choice([None, -1, *range(500)]), "x") for _ in range(70)] + [(9, date(2026, 3, 1), 4, "one")]
    df = spark.createDataFrame(data, "e int, d date, v int, source string")
    got = {(r["source"], r["day"]): (r["value"], r["status"]) for r in grid.regular_grid(df, "e", "d", "v", shard_days=shard, long_gap=6).collect()}
    by = defaultdict(dict)
    for e, d, v, _ in data:
        if e is not None and d is not None and v is not None and v >= 0:
            by[e][d] = min(v, by[e].get(d, v))
    want = {}
    for e, r in by.items():
        days = sorted(r)
        xs, ys = [(d - days[0]).days for d in days], [float(r[d]) for d in days]
        for x in range(xs[-1] + 1):
            d = days[0] + timedelta(x)
            if x in xs:
                want[e, d] = (float(r[d]), "reading")
            else:
                gap = min(y for y in xs if y > x) - max(y for y in xs if y < x) - 1
                want[e, d] = (None, "gap") if gap > 6 else (_pchip(xs, ys, x), "filled")
    assert got.keys() == want.keys()
    for k, (v, s) in want.items():
        assert got[k][1] == s and (v is None) == (got[k][0] is None), k
        assert v is None or abs(v - got[k][0]) < 1e-9, k


def test_grid_of_nothing(spark):
    assert grid.regular_grid(spark.createDataFrame([], "e int, d date, v int"), "e", "d", "v").count() == 0


# --- trailing totals


@pytest.mark.parametrize("n", [1, 2, 7, 30])
def test_trailing_totals(spark, n):
    rng = random.Random(n)
    data = {(e, rng.randrange(100, 180)): rng.choice([0, 0, 5, 17]) for e in (1, 2, 3) for _ in range(12)}
    df = spark.createDataFrame([(e, d, v) for (e, d), v in data.items()], "entity int, d int, v long")
    total = lambda e, d: sum(data.get((e, x), 0) for x in range(d - n + 1, d + 1))
    totals = rolling.trailing_totals(df, n)
    assert {(r["entity"], r["d"]): (r["v"], r["t"], r["t_out"]) for r in totals.collect()} == {(e, d): (v, total(e, d), total(e, d + n)) for (e, d), v in data.items()}
    peaks, falls = set(), set()
    for e in (1, 2, 3):
        days = range(min(d for x, d in data if x == e), 171)
        top = max(total(e, d) for d in days)
        peaks |= {(e, next(d for d in days if total(e, d) == top))} if top else set()
        falls |= {(e, d) for d in days if total(e, d) == 0 and total(e, d - 1) > 0}
    rest = rolling.trailing_totals(df.where("d <= 170"), n)
    assert set(map(tuple, rolling.peak_days(rest, F.lit(170)).collect())) == peaks
    assert sorted(map(tuple, rolling.falls_to_zero(rest, n, F.lit(170)).collect())) == sorted(falls)
    assert rolling.trailing_totals(df.limit(0), n).count() == 0


def test_all_windows_at_once(spark):
    rng = random.Random(5)
    data = {(e, rng.randrange(-50, 500)): rng.choice([0, 3, 11]) for e in (1, 2, 3, 4) for _ in range(9)}
    df = spark.createDataFrame([(e, d, v) for (e, d), v in data.items()], "entity int, d int, v long")
    got = {(r["entity"], r["d"]): (r["total_2"], r["total_3"], r["total_5"]) for r in rolling.rolling_totals(df, F.lit(460), (2, 3, 5)).collect()}
    total = lambda e, d, n: sum(data.get((e, x), 0) for x in range(d - n + 1, d + 1))
    want = {(e, d): tuple(total(e, d, n) for n in (2, 3, 5)) for e in (1, 2, 3, 4) for d in range(min(x for y, x in data if y == e), 461)}
    assert got == want


def test_spending_counts_each_order_and_line_once(spark):
    t = datetime(2026, 1, 1, 23, 59)
    orders = spark.createDataFrame([(1, 5, t, "PAID"), (1, 5, t, "x"), (2, None, t, ""), (3, 5, None, ""), (None, 5, t, ""), (4, 6, t, "")], "order_id int, customer_id int, order_ts timestamp_ntz, v string")
    items = spark.createDataFrame([(1, 1, 2, 1.5), (1, 1, 2, 1.5), (1, 2, 1, None), (1, None, 1, 4.0), (9, 1, 1, 1.0)], "order_id int, line_no int, quantity int, unit_price double")
    assert rows(rolling.daily_spending(orders, items), "entity", "v") == [(5, 700), (6, 0)]
    assert rolling.rolling_totals(rolling.daily_spending(orders.limit(0), items), F.lit(20000)).count() == 0


# --- hierarchies


def _brute_roots(parent):
    out = {}
    for n in parent:
        path, x = [], n
        while x in parent and x not in path:
            path.append(x)
            x = parent[x]
        root = min(path[path.index(x) :]) if x in path else path[-1]
        out[n] = path[: path.index(root) + 1]
    return out


@pytest.mark.parametrize("one_in", [1, 2, 5, 10_000])
def test_hierarchy(spark, one_in):
    rng = random.Random(one_in)
    parent = {i: rng.choice([None, 999, rng.randrange(1, 61), i - 1 or None, i - 1 or None]) for i in range(1, 61)}
    parent |= {100 + i: 100 + (i + 1) % 7 for i in range(7)} | {200: 103, 201: 200, 300: 300, 301: 300}
    data = [(k, v, "x", 0) for k, v in parent.items()] * 2 + [(None, 3, "", 0)]
    df = spark.createDataFrame(data, "customer_id int, referred_by int, path string, depth int")
    want = _brute_roots(parent)
    got = {r["id"]: r["up_path"] for r in hierarchy.resolve(df, "customer_id", "referred_by", one_in).collect()}
    assert got == want
    roots = hierarchy.roots(df, "customer_id", "referred_by", one_in)
    assert roots.columns == ["id", "root_id"] and {r["id"]: r["root_id"] for r in roots.collect()} == {k: v[-1] for k, v in got.items()}
    full = {r["id"]: r for r in hierarchy.hierarchy(df, "customer_id", "referred_by", one_in).collect()}
    for n, r in full.items():
        assert r["path"] == want[n][::-1] and r["depth"] == len(want[n]) - 1 and r["root_id"] == want[n][-1]
        assert r["n_descendants"] == sum(n in p[1:] for p in want.values())
        x, seen = parent.get(n), set()
        while x in parent and x not in seen:
            seen.add(x)
            x = parent[x]
        assert r["in_loop"] == (n in seen), n


def test_long_chain_and_empty(spark):
    df = spark.range(1, 400).select(F.col("id"), (F.col("id") - 1).alias("up"))
    got = {r["id"]: len(r["up_path"]) for r in hierarchy.resolve(df, "id", "up", 8).collect()}
    assert got == {i: i for i in range(1, 400)}
    assert hierarchy.resolve(df.limit(0), "id", "up").count() == 0
    assert hierarchy.descendants(df.where("id < 4"), "id", "up").count() == 3


def test_satellites_split_by_rate(spark):
    rng = random.Random(8)
    said = [(k, date(2026, 1, 1) + timedelta(days=7 * i), rng.choice("ab") * (i > 2), rng.randrange(10**6), "same") for k in (1, 2, 3) for i in range(9)]
    first, late = said[::2], said[1::2]
    frame = lambda rs: spark.createDataFrame(rs, "k int, t date, slow string, fast int, still string")
    stored = satellites.load([frame(first), frame(late)], "k", "t", ["slow", "fast", "still"], (0.02, 0.95))
    assert {tuple(g) for g, _ in stored.values()} == {("slow",), ("fast",), ("still",)}
    got = [tuple(r) for r in satellites.joined_history(stored, "k", "t").select("k", "slow", "fast", "still", "t", "valid_to").orderBy("k", "t").collect()]
    want = []
    for i, (k, t, slow, fast, still) in enumerate(sorted(said, key=lambda r: r[:2])):
        if want and want[-1][0] == k:
            want[-1] = (*want[-1][:-1], t)
        want.append((k, slow, fast, still, t, None))
    assert got == want
    assert satellites.joined_history(satellites.load([frame(first).limit(0)], "k", "t", ["slow", "fast"]), "k", "t").count() == 0
