"""Queries of the general problems 2 to 6."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.operators import grid, hierarchy, references, rolling, satellites
from tesseral.sources.readers import table

#: The last day of the trailing periods.
LAST_DAY = date(2026, 6, 30)
_DAY = "yyyy-MM-dd"


def _children(spark: SparkSession, d: str) -> list[references.Child]:
    return [
        references.Child("refunds", table(spark, d, "refunds"), "refund_id", "order_id", "refund_ts"),
        references.Child("payments", table(spark, d, "payments"), "payment_id", "order_id", "paid_ts"),
    ]


def _orders(spark: SparkSession, d: str) -> list[tuple[DataFrame, str]]:
    return [(table(spark, d, "ticket_orders"), "order_id"), (table(spark, d, "late_orders"), "order_id")]


def p2_found(spark, d):
    return references.orphan_rows(_children(spark, d), _orders(spark, d)).select("child_table", "child_id", F.col("_key").alias("order_id"))


def p2_report(spark, d):
    return references.orphan_report(_children(spark, d), _orders(spark, d))


def p2_late(spark, d):
    early, late = _orders(spark, d)
    return references.late_report(_children(spark, d), [early], [late])


def _statements(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    def said(name: str, day: str) -> DataFrame:
        city = satellites.tidy("city")
        return table(spark, d, name).select("customer_id", city.alias("city"), F.col(day).alias("valid_from")).where("city <> ''")

    return said("dim_customer_city", "valid_from"), said("city_changes", "changed_on")


def _history(spark, d):
    stored = satellites.load(list(_statements(spark, d)), "customer_id", "valid_from", ["city"])
    return satellites.joined_history(stored, "customer_id", "valid_from")


def p3_history(spark, d):
    return _history(spark, d)


def p3_found(spark, d):
    return _history(spark, d).select("customer_id", "city", F.date_format("valid_from", _DAY).alias("valid_from"))


def p3_change_rates(spark, d):
    return satellites.change_rates(table(spark, d, "dim_customer_city"), "customer_id", "valid_from", ["city", "valid_to", "is_current"])


def _grid(spark, d):
    return grid.regular_grid(table(spark, d, "seat_inventory"), "event_id", "snapshot_date", "seats_remaining")


def p4_grid(spark, d):
    return _grid(spark, d).select(F.col("source").alias("event_id"), "day", F.round("value", 6).alias("seats"), "status")


def p4_found(spark, d):
    return _grid(spark, d).where("status <> 'reading'").select(F.col("source").alias("event_id"), F.date_format("day", _DAY).alias("missing_day"))


def _daily(spark, d):
    cols = ["order_id", "customer_id", "order_ts"]
    orders = table(spark, d, "ticket_orders").select(*cols).unionByName(table(spark, d, "late_orders").select(*cols))
    return rolling.daily_spending(orders, table(spark, d, "order_items"))


def _last_day():
    return F.unix_date(F.lit(LAST_DAY))


def p5_rolling(spark, d):
    rows = rolling.rolling_totals(_daily(spark, d), _last_day())
    return rows.select(
        F.col("entity").alias("customer_id"),
        F.date_from_unix_date("d").alias("day"),
        *[(F.col(f"total_{n}") / 100).alias(f"total_{n}") for n in (7, 30)],
        *[F.round(F.col(f"average_{n}") / 100, 6).alias(f"average_{n}") for n in (7, 30)],
    )


def p5_found(spark, d):
    daily, last = _daily(spark, d).where(F.col("d") <= _last_day()), _last_day()
    peaks = rolling.peak_days(rolling.trailing_totals(daily, 7), last).select("entity", F.lit("peak_7").alias("kind"), "d")
    quiet = rolling.falls_to_zero(rolling.trailing_totals(daily, 30), 30, last).select("entity", F.lit("quiet_30").alias("kind"), "d")
    return peaks.unionByName(quiet).select(F.col("entity").alias("customer_id"), "kind", F.date_format(F.date_from_unix_date("d"), _DAY).alias("day"))


def p6_found(spark, d):
    people = table(spark, d, "customers")
    referred = people.where("referred_by is not null and customer_id is not null").select("customer_id").distinct()
    found = hierarchy.roots(people, "customer_id", "referred_by").select(F.col("id").alias("customer_id"), "root_id")
    return found.join(referred, "customer_id", "left_semi")


def p6_hierarchy(spark, d):
    return hierarchy.hierarchy(table(spark, d, "customers"), "customer_id", "referred_by").withColumnRenamed("id", "customer_id")


def p6_descendants(spark, d):
    return hierarchy.descendants(table(spark, d, "customers"), "customer_id", "referred_by").withColumnRenamed("id", "customer_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p2_late, p3_found, p3_history, p3_change_rates, p4_found, p4_grid, p5_found, p5_rolling, p6_found, p6_hierarchy, p6_descendants)}

_CITY = r"trim(regexp_replace(lower(city), '\s+', ' ', 'g'))"
_VERSIONS = rf"""
WITH said AS (SELECT DISTINCT customer_id, {_CITY} AS city, d FROM (
    SELECT customer_id, city, valid_from AS d FROM dim_customer_city UNION ALL SELECT customer_id, city, changed_on FROM city_changes) s
  WHERE d IS NOT NULL AND customer_id IS NOT NULL AND {_CITY} <> ''),
v AS (SELECT *, lag(city) OVER (PARTITION BY customer_id ORDER BY d, city) AS p FROM said),
h AS (SELECT customer_id, city, d AS valid_from FROM v WHERE p IS DISTINCT FROM city)
"""
_ORPHANS = """
WITH child AS (SELECT 'refunds' AS child_table, refund_id AS child_id, order_id, strftime(refund_ts, '%Y-%m') AS period FROM refunds
  UNION ALL SELECT 'payments', payment_id, order_id, strftime(paid_ts, '%Y-%m') FROM payments),
parent AS (SELECT order_id FROM ticket_orders WHERE order_id IS NOT NULL UNION SELECT order_id FROM late_orders WHERE order_id IS NOT NULL)
"""
_SPEND = """
WITH o AS (SELECT order_id, min(customer_id) AS customer_id, min(order_ts) AS ts FROM (
    SELECT order_id, customer_id, order_ts FROM ticket_orders UNION ALL SELECT order_id, customer_id, order_ts FROM late_orders) x
  WHERE order_id IS NOT NULL AND customer_id IS NOT NULL AND order_ts IS NOT NULL GROUP BY order_id),
l AS (SELECT order_id, sum(w) AS w FROM (SELECT order_id, line_no, max(coalesce(round(unit_price * 100)::BIGINT * quantity, 0)) AS w FROM order_items
  WHERE order_id IS NOT NULL GROUP BY ALL) GROUP BY order_id),
daily AS (SELECT customer_id, ts::DATE AS day, sum(coalesce(w, 0))::BIGINT AS v FROM o LEFT JOIN l USING (order_id) WHERE ts::DATE <= DATE '2026-06-30' GROUP BY customer_id, ts::DATE),
cal AS (SELECT customer_id, unnest(generate_series(min(day), DATE '2026-06-30', INTERVAL 1 DAY))::DATE AS day FROM daily GROUP BY customer_id),
t AS (SELECT customer_id, day, sum(coalesce(v, 0)) OVER (w7 ROWS 6 PRECEDING)::BIGINT AS t7, sum(coalesce(v, 0)) OVER (w7 ROWS 29 PRECEDING)::BIGINT AS t30
  FROM cal LEFT JOIN daily USING (customer_id, day) WINDOW w7 AS (PARTITION BY customer_id ORDER BY day))
"""
_ROOTS = """
WITH RECURSIVE n AS (SELECT customer_id AS id, min(referred_by) AS p FROM customers WHERE customer_id IS NOT NULL GROUP BY 1),
e AS (SELECT n.id, m.id AS p FROM n LEFT JOIN n m ON n.p = m.id),
w AS (SELECT id, [id] AS path, p AS nxt FROM e
  UNION ALL SELECT w.id, list_append(w.path, e.id), e.p FROM w JOIN e ON w.nxt = e.id WHERE NOT list_contains(w.path, w.nxt)),
f AS (SELECT id, path, CASE WHEN nxt IS NULL THEN path[-1] ELSE list_min(path[list_position(path, nxt):]) END AS root_id, nxt
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY len(path) DESC) AS r FROM w) WHERE r = 1)
"""

ORACLE = {
    "p2_found": _ORPHANS + "SELECT DISTINCT child_table, child_id, order_id FROM child WHERE order_id IS NOT NULL AND order_id NOT IN (SELECT order_id FROM parent)",
    "p2_report": _ORPHANS
    + """SELECT child_table, period, count(*) AS n_references, count(*) FILTER (WHERE parent.order_id IS NULL) AS n_orphans,
  count(DISTINCT child.order_id) FILTER (WHERE parent.order_id IS NULL) AS n_orphan_keys
FROM child LEFT JOIN parent ON child.order_id = parent.order_id WHERE child.order_id IS NOT NULL GROUP BY ALL""",
    "p2_late": _ORPHANS + """SELECT child_table, period, count(*) AS n_late, count(DISTINCT order_id) AS n_late_keys FROM child WHERE order_id IN (SELECT order_id FROM late_orders)
  AND order_id NOT IN (SELECT order_id FROM ticket_orders WHERE order_id IS NOT NULL) GROUP BY ALL""",
    "p3_found": _VERSIONS + "SELECT customer_id, city, strftime(valid_from, '%Y-%m-%d') AS valid_from FROM h",
    "p3_history": _VERSIONS + "SELECT *, lead(valid_from) OVER (PARTITION BY customer_id ORDER BY valid_from, city) AS valid_to FROM h",
    "p4_found": """WITH r AS (SELECT DISTINCT event_id, snapshot_date AS day FROM seat_inventory WHERE event_id IS NOT NULL AND snapshot_date IS NOT NULL AND seats_remaining >= 0),
c AS (SELECT event_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM r GROUP BY event_id)
SELECT event_id, strftime(day, '%Y-%m-%d') AS missing_day FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.event_id = c.event_id AND r.day = c.day)""",
    "p3_change_rates": """WITH s AS (SELECT DISTINCT customer_id, valid_from, city, valid_to, is_current FROM dim_customer_city WHERE customer_id IS NOT NULL AND valid_from IS NOT NULL),
f AS (SELECT row_number() OVER w AS k, city IS DISTINCT FROM lag(city) OVER w AS a, valid_to IS DISTINCT FROM lag(valid_to) OVER w AS b, is_current IS DISTINCT FROM lag(is_current) OVER w AS c FROM s
  WINDOW w AS (PARTITION BY customer_id ORDER BY valid_from NULLS FIRST, city NULLS FIRST, valid_to NULLS FIRST, is_current NULLS FIRST))
SELECT unnest(['city', 'valid_to', 'is_current']) AS attribute, unnest([avg(a::INT), avg(b::INT), avg(c::INT)]) AS rate FROM f WHERE k > 1""",
    "p4_grid": """WITH p AS (SELECT event_id, snapshot_date AS x, min(seats_remaining)::DOUBLE AS y FROM seat_inventory WHERE event_id IS NOT NULL AND snapshot_date IS NOT NULL AND seats_remaining >= 0 GROUP BY ALL),
s AS (SELECT *, (lead(x) OVER w - x)::DOUBLE AS h, lead(y) OVER w AS y1 FROM p WINDOW w AS (PARTITION BY event_id ORDER BY x)),
c AS (SELECT *, (y1 - y) / h AS m FROM s),
n AS (SELECT *, lag(h) OVER w AS ha, lag(m) OVER w AS ma, lead(h) OVER w AS hb, lead(m) OVER w AS mb FROM c WINDOW w AS (PARTITION BY event_id ORDER BY x)),
v AS (SELECT *, CASE WHEN ma * m <= 0 THEN 0.0 ELSE (3 * (ha + h)) / ((2 * h + ha) / ma + (h + 2 * ha) / m) END AS inner0, CASE WHEN m * mb <= 0 THEN 0.0 ELSE (3 * (h + hb)) / ((2 * hb + h) / m + (hb + 2 * h) / mb) END AS inner1,
  ((2 * h + hb) * m - h * mb) / (h + hb) AS e0, ((2 * h + ha) * m - h * ma) / (h + ha) AS e1 FROM n),
g AS (SELECT *, CASE WHEN ha IS NOT NULL THEN inner0 WHEN hb IS NULL THEN m WHEN sign(e0) <> sign(m) THEN 0 WHEN sign(m) <> sign(mb) AND abs(e0) > 3 * abs(m) THEN 3 * m ELSE e0 END AS d0,
  CASE WHEN hb IS NOT NULL THEN inner1 WHEN ha IS NULL THEN m WHEN sign(e1) <> sign(m) THEN 0 WHEN sign(m) <> sign(ma) AND abs(e1) > 3 * abs(m) THEN 3 * m ELSE e1 END AS d1 FROM v),
k AS (SELECT *, unnest(range(0, greatest(coalesce(h, 1), 1)::BIGINT)) AS k FROM g),
q AS (SELECT *, k / h AS t FROM k)
SELECT event_id, x + k::INT AS day, CASE WHEN k = 0 THEN 'reading' WHEN h - 1 > 14 THEN 'gap' ELSE 'filled' END AS status,
  round(CASE WHEN k = 0 THEN y WHEN h - 1 <= 14 THEN least(greatest((1 + 2 * t) * (1 - t) * (1 - t) * y + t * (1 - t) * (1 - t) * h * d0 + t * t * (3 - 2 * t) * y1 + t * t * (t - 1) * h * d1, least(y, y1)), greatest(y, y1)) END, 6) AS seats FROM q""",
    "p5_found": _SPEND
    + """, q AS (SELECT *, lag(t30) OVER (PARTITION BY customer_id ORDER BY day) AS b FROM t)
SELECT customer_id, 'peak_7' AS kind, strftime(min(day), '%Y-%m-%d') AS day FROM (SELECT *, max(t7) OVER (PARTITION BY customer_id) AS m FROM t) WHERE t7 = m AND m > 0 GROUP BY customer_id
UNION ALL SELECT customer_id, 'quiet_30', strftime(day, '%Y-%m-%d') FROM q WHERE t30 = 0 AND b > 0""",
    "p5_rolling": _SPEND + "SELECT customer_id, day, t7 / 100.0::DOUBLE AS total_7, t30 / 100.0::DOUBLE AS total_30, round(t7 / 7.0::DOUBLE / 100, 6) AS average_7, round(t30 / 30.0::DOUBLE / 100, 6) AS average_30 FROM t",
    "p6_found": _ROOTS + "SELECT id AS customer_id, root_id FROM f WHERE id IN (SELECT customer_id FROM customers WHERE referred_by IS NOT NULL)",
    "p6_hierarchy": _ROOTS
    + """, g AS (SELECT id, root_id, path[:list_position(path, root_id)] AS up, nxt IS NOT NULL AND list_contains(path[list_position(path, nxt):], id) AS in_loop FROM f),
c AS (SELECT a AS id, count(*) AS n FROM (SELECT unnest(up[2:]) AS a FROM g) GROUP BY 1)
SELECT g.id AS customer_id, root_id, (len(up) - 1)::INT AS depth, list_reverse(up) AS path, in_loop, coalesce(n, 0)::BIGINT AS n_descendants FROM g LEFT JOIN c USING (id)""",
    "p6_descendants": _ROOTS
    + """, g AS (SELECT id, path[:list_position(path, root_id)] AS up FROM f)
SELECT a AS customer_id, id AS descendant_id, i::INT AS distance FROM (SELECT id, unnest(up[2:]) AS a, unnest(range(1, len(up))) AS i FROM g)""",
}
