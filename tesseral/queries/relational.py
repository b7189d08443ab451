"""Projection, filters, joins, grouping, windows, subqueries, set operations, sorting and CTEs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesseral.queries.base import Book
from tesseral.sources.readers import table

B = Book()
QUERIES, ORACLE = B.queries, B.oracle

_REV = "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE)"
_FLAG = """
WITH m AS (SELECT n_name AS nation, {month} AS month, {rev} AS revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT nation, month, revenue, CAST(row_number() OVER (PARTITION BY nation ORDER BY revenue DESC, month) AS BIGINT) AS rn FROM m
QUALIFY rn <= 3
"""
B.sql("flagship", _FLAG.format(month="date_format(o_orderdate, 'yyyy-MM')", rev=_REV), _FLAG.format(month="strftime(o_orderdate, '%Y-%m')", rev=_REV))

# --- projection and predicates
B.sql("filter_and_or", "SELECT o_orderkey, o_orderstatus FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR (o_orderstatus = 'O' AND o_orderpriority LIKE '1%')")
B.sql("case_bands", "SELECT p_partkey, CASE WHEN p_retailprice < 1000 THEN 'low' WHEN p_retailprice < 1500 THEN 'mid' ELSE 'high' END AS band, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS size_word FROM part")
B.sql("distinct_pairs", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
B.sql("null_logic", "SELECT customer_id, email IS NULL AS no_email, loyalty_tier IS NOT NULL AND loyalty_tier = 'Gold' AS gold, (loyalty_tier = 'Gold') IS TRUE AS gold_true, (marketing_opt_in) IS NOT FALSE AS not_refused FROM customers")
B.sql("between_dates", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE'1995-03-01' AND DATE'1995-06-30' AND o_totalprice NOT BETWEEN 1000 AND 50000")
B.sql("in_list", "SELECT order_id, status FROM ticket_orders WHERE status IN ('PAID', 'REFUNDED') AND channel NOT IN ('web')")
B.sql(
    "like_ilike_any",
    "SELECT event_id, artist LIKE 'The %' AS the_act, artist ILIKE '%CHOIR' AS choir, artist LIKE ANY ('%Trio%', '%Union') AS some_of, artist NOT LIKE ALL ('A%', 'B%') AS none_of, artist RLIKE '^[A-K]' AS first_half FROM concerts",
    "SELECT event_id, artist LIKE 'The %' AS the_act, artist ILIKE '%CHOIR' AS choir, artist LIKE '%Trio%' OR artist LIKE '%Union' AS some_of, artist NOT LIKE 'A%' AND artist NOT LIKE 'B%' AS none_of, regexp_matches(artist, '^[A-K]') AS first_half FROM concerts",
)
B.sql("null_safe_eq", "SELECT a.order_id, a.promo_code <=> 'PLUSONE' AS plus_one, a.customer_id IS DISTINCT FROM 1001 AS other FROM ticket_orders a", "SELECT order_id, promo_code IS NOT DISTINCT FROM 'PLUSONE' AS plus_one, customer_id IS DISTINCT FROM 1001 AS other FROM ticket_orders")
B.sql(
    "arithmetic_ansi",
    "SELECT p_partkey, p_size / 4 AS q, CAST(p_size DIV 4 AS BIGINT) AS d, CAST(-p_size % 4 AS BIGINT) AS m, p_size & 6 AS a, p_size | 1 AS o, p_size ^ 3 AS x, try_divide(p_size, p_size - 1) AS t FROM part",
    "SELECT p_partkey, p_size / 4.0::DOUBLE AS q, (p_size // 4)::BIGINT AS d, (-p_size % 4)::BIGINT AS m, p_size & 6 AS a, p_size | 1 AS o, xor(p_size, 3) AS x, CASE WHEN p_size <> 1 THEN p_size / (p_size - 1)::DOUBLE END AS t FROM part",
)
B.sql("star_except", "SELECT * EXCEPT (s_acctbal, s_nationkey) FROM supplier", "SELECT * EXCLUDE (s_acctbal, s_nationkey) FROM supplier")
B.sql("lateral_alias", "SELECT order_id, line_no, coalesce(unit_price, 0) AS p, p * quantity AS worth, worth > 300 AS large FROM order_items")
B.sql("values_inline", "SELECT k, v FROM VALUES (1, 'a'), (2, 'b'), (3, NULL) AS t(k, v)", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v)")
B.sql("range_tvf", "SELECT id FROM range(10, 0, -2)", "SELECT range AS id FROM range(10, 0, -2)")
B.sql("tvf_explode", "SELECT v FROM explode(ARRAY[3, 1, 2]) AS t(v)", "SELECT unnest([3, 1, 2]) AS v")
B.sql("derived_table", "SELECT t.k, t.n FROM (SELECT l_shipmode_free, count(*) FROM (SELECT l_returnflag AS l_shipmode_free FROM lineitem) GROUP BY 1) AS t(k, n)")
B.sql("row_constructor", "SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_orderpriority) = ('F', '1-URGENT')")

B.sql("table_statement", "TABLE region", "SELECT * FROM region")

# --- joins
B.sql("inner_multi", "SELECT o.order_id, c.full_name, e.artist FROM ticket_orders o JOIN customers c ON o.customer_id = c.customer_id JOIN concerts e ON o.event_id = e.event_id WHERE o.status = 'PAID'")
B.sql("left_on_filter", "SELECT s_suppkey, count(l_orderkey) AS bulk_lines FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity >= 49 AND l_discount > 0.09 GROUP BY s_suppkey")
B.sql("right_join", "SELECT e.event_id, count(s.snapshot_date) AS n FROM seat_inventory s RIGHT JOIN concerts e ON s.event_id = e.event_id GROUP BY e.event_id")
B.sql("full_outer", "SELECT coalesce(p.order_id, r.order_id) AS order_id, p.order_id IS NULL AS no_payment, r.order_id IS NULL AS no_refund FROM (SELECT DISTINCT order_id FROM payments WHERE order_id IS NOT NULL) p FULL OUTER JOIN (SELECT DISTINCT order_id FROM refunds WHERE order_id IS NOT NULL) r ON p.order_id = r.order_id")
B.sql("cross_join", "SELECT r_name, pack_id FROM region CROSS JOIN pack_sizes")
B.sql("comma_join", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
B.sql("semi_join", "SELECT DISTINCT e.event_id, e.artist FROM concerts e LEFT SEMI JOIN (SELECT o.event_id FROM ticket_orders o JOIN refunds r ON o.order_id = r.order_id) x ON e.event_id = x.event_id", "SELECT DISTINCT event_id, artist FROM concerts WHERE event_id IN (SELECT o.event_id FROM ticket_orders o JOIN refunds r ON o.order_id = r.order_id WHERE o.event_id IS NOT NULL)")
B.sql("anti_join", "SELECT o_orderkey FROM orders LEFT ANTI JOIN lineitem ON o_orderkey = l_orderkey", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
B.sql("using_join", "SELECT order_id, o.status, p.method FROM ticket_orders o JOIN payments p USING (order_id)")
B.sql("natural_join", "SELECT event_id, artist, seats_remaining FROM concerts NATURAL JOIN seat_inventory")
B.sql("self_join", "SELECT a.s_suppkey, b.s_suppkey AS above FROM supplier a LEFT JOIN supplier b ON b.s_suppkey = a.s_suppkey DIV 2", "SELECT a.s_suppkey, b.s_suppkey AS above FROM supplier a LEFT JOIN supplier b ON b.s_suppkey = a.s_suppkey // 2")
_RATES = "(VALUES ('A', DATE'1992-01-01', DATE'1995-06-30', 1.0), ('B', DATE'1995-07-01', DATE'9999-12-31', 1.5)) AS r(code, valid_from, valid_to, rate)"
B.sql("range_join", f"SELECT code, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2)) * rate) AS DOUBLE) AS amount FROM orders JOIN {_RATES} ON CAST(o_orderdate AS DATE) BETWEEN r.valid_from AND r.valid_to GROUP BY code")
B.sql("theta_join", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_LATERAL = "SELECT n_name, s_name, s_acctbal FROM nation JOIN LATERAL (SELECT s_name, s_acctbal FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 2) x"
B.sql("lateral_join", _LATERAL, _LATERAL + " ON true")
B.sql("left_lateral", "SELECT n_name, top FROM nation LEFT JOIN LATERAL (SELECT max(s_acctbal) AS top FROM supplier WHERE s_nationkey = n_nationkey HAVING count(*) > 3) x", "SELECT n_name, top FROM nation LEFT JOIN LATERAL (SELECT max(s_acctbal) AS top FROM supplier WHERE s_nationkey = n_nationkey HAVING count(*) > 3) x ON true")
B.sql("lateral_explode", "SELECT n_nationkey, x FROM nation, LATERAL explode(sequence(0, n_regionkey)) AS t(x)", "SELECT n_nationkey, unnest(range(0, n_regionkey + 1))::INT AS x FROM nation")
B.sql("null_key_join", "SELECT count(*) AS n FROM ticket_orders a JOIN ticket_orders b ON a.customer_id = b.customer_id AND a.order_id = b.order_id")
B.sql(
    "fanout_fixed",
    "SELECT o.order_id, i.items, p.paid FROM (SELECT DISTINCT order_id FROM ticket_orders) o JOIN (SELECT order_id, sum(quantity) AS items FROM order_items GROUP BY 1) i ON i.order_id = o.order_id JOIN (SELECT order_id, CAST(sum(CAST(round(amount, 2) AS DECIMAL(18,2))) AS DOUBLE) AS paid FROM payments GROUP BY 1) p ON p.order_id = o.order_id",
    "SELECT o.order_id, i.items::BIGINT AS items, p.paid FROM (SELECT DISTINCT order_id FROM ticket_orders) o JOIN (SELECT order_id, sum(quantity) AS items FROM order_items GROUP BY 1) i ON i.order_id = o.order_id JOIN (SELECT order_id, CAST(sum(CAST(round(amount, 2) AS DECIMAL(18,2))) AS DOUBLE) AS paid FROM payments GROUP BY 1) p ON p.order_id = o.order_id",
)
B.sql("parenthesised_join", "SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN (supplier JOIN region ON s_suppkey % 5 = r_regionkey) ON s_nationkey = n_nationkey GROUP BY n_name")

# --- subqueries
B.sql("scalar_subquery", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) * 1.3 FROM part)")
B.sql("correlated_scalar", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
B.sql("correlated_theta", "SELECT n_name, (SELECT count(*) FROM nation b WHERE b.n_name < a.n_name) AS earlier FROM nation a")
B.sql("exists_subquery", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
B.sql("not_exists_subquery", "SELECT customer_id FROM customers c WHERE NOT EXISTS (SELECT 1 FROM ticket_orders o WHERE o.customer_id = c.customer_id)")
B.sql("in_subquery", "SELECT order_id FROM payments WHERE order_id IN (SELECT order_id FROM refunds)")
B.sql("not_in_null", "SELECT p_partkey FROM part WHERE p_size NOT IN (SELECT nullif(s_nationkey, 7) FROM supplier)")
B.sql("not_in_clean", "SELECT p_partkey FROM part WHERE p_size NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)")
B.sql("having_subquery", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > (SELECT avg(k) FROM (SELECT count(*) AS k FROM orders GROUP BY o_custkey))")

# --- set operations, sorting
B.sql("union_distinct", "SELECT city FROM dim_customer_city UNION SELECT city FROM city_changes")
B.sql("union_all", "SELECT order_id, amount FROM payments UNION ALL SELECT order_id, -amount FROM refunds")
B.sql("intersect_op", "SELECT order_id FROM payments INTERSECT SELECT order_id FROM refunds")
B.sql("intersect_all", "SELECT order_id FROM payments INTERSECT ALL SELECT order_id FROM refunds")
B.sql("except_op", "SELECT order_id FROM ticket_orders EXCEPT SELECT order_id FROM payments")
B.sql("except_all", "SELECT order_id FROM payments EXCEPT ALL SELECT order_id FROM ticket_orders")
B.sql("set_precedence", "SELECT 1 AS x UNION SELECT 2 INTERSECT SELECT 2 EXCEPT SELECT 3")
B.sql("order_nulls", "SELECT customer_id, signup_date FROM customers ORDER BY signup_date DESC NULLS FIRST, customer_id LIMIT 50", "SELECT DISTINCT ON (rn) customer_id, signup_date FROM (SELECT customer_id, signup_date, row_number() OVER (ORDER BY signup_date DESC NULLS FIRST, customer_id) AS rn FROM customers) WHERE rn <= 50")
B.sql("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
B.sql("topk", "SELECT l_orderkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey LIMIT 25")
B.sql("order_by_alias", "SELECT n_name AS n, n_regionkey * 10 AS k FROM nation ORDER BY k DESC, 1 LIMIT 7")
# the whole order: rn is the place that a row has in the sorted output
_PLACED = "SELECT {cols}, CAST(row_number() OVER (ORDER BY place) AS BIGINT) AS rn FROM (SELECT *, monotonically_increasing_id() AS place FROM ({sorted}))"
B.sql("order_nulls_all", _PLACED.format(cols="customer_id, signup_date", sorted="SELECT customer_id, signup_date FROM customers ORDER BY signup_date DESC NULLS FIRST, customer_id"), "SELECT customer_id, signup_date, row_number() OVER (ORDER BY signup_date DESC NULLS FIRST, customer_id NULLS FIRST) AS rn FROM customers")
B.sql("order_by_alias_all", _PLACED.format(cols="n, k", sorted="SELECT n_name AS n, n_regionkey * 10 AS k FROM nation ORDER BY k DESC, 1"), "SELECT n_name AS n, n_regionkey * 10 AS k, row_number() OVER (ORDER BY n_regionkey DESC, n_name) AS rn FROM nation")

# --- grouping
B.sql("group_multi", f"SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS qty, {_REV} AS revenue, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
B.sql("group_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
B.sql("group_ordinal", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1", "SELECT year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY 1")
B.sql("group_null_key", "SELECT loyalty_tier, count(*) AS n FROM customers GROUP BY loyalty_tier")
B.sql("having_alias", "SELECT customer_id, count(*) AS n FROM ticket_orders GROUP BY customer_id HAVING n > 20")
B.sql("filter_agg", "SELECT p_brand, count(*) FILTER (WHERE p_size > 30) AS large, sum(p_size) FILTER (WHERE p_retailprice < 1200) AS cheap_sizes, max(p_retailprice) FILTER (WHERE p_size % 2 = 0) AS even_top FROM part GROUP BY p_brand", "SELECT p_brand, count(*) FILTER (WHERE p_size > 30) AS large, CAST(sum(p_size) FILTER (WHERE p_retailprice < 1200) AS BIGINT) AS cheap_sizes, max(p_retailprice) FILTER (WHERE p_size % 2 = 0) AS even_top FROM part GROUP BY p_brand")
B.sql("count_distinct_multi", "SELECT count(DISTINCT customer_id, event_id) AS pairs, count_distinct(promo_code) AS codes FROM ticket_orders", "SELECT (SELECT count(*) FROM (SELECT DISTINCT customer_id, event_id FROM ticket_orders WHERE customer_id IS NOT NULL AND event_id IS NOT NULL)) AS pairs, count(DISTINCT promo_code) AS codes FROM ticket_orders")
B.sql("rollup_op", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
B.sql("cube_op", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
B.sql("with_rollup", "SELECT channel, count(*) AS n FROM ticket_orders GROUP BY channel WITH ROLLUP", "SELECT channel, count(*) AS n FROM ticket_orders GROUP BY ROLLUP (channel)")
B.sql("grouping_sets", "SELECT channel, status, count(*) AS n FROM ticket_orders GROUP BY GROUPING SETS ((channel), (status), ())")
B.sql("grouping_id_op", "SELECT channel, status, CAST(grouping(channel) AS BIGINT) AS g, grouping_id() AS gid, count(*) AS n FROM ticket_orders GROUP BY CUBE (channel, status)", "SELECT channel, status, grouping(channel)::BIGINT AS g, grouping(channel, status)::BIGINT AS gid, count(*) AS n FROM ticket_orders GROUP BY CUBE (channel, status)")
B.sql("max_by_min_by", "SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS top, min_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS low FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS top, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS low FROM orders GROUP BY o_custkey")
B.sql("percentiles", "SELECT p_brand, median(p_retailprice) AS med, percentile(p_retailprice, 0.9) AS p90, percentile_cont(0.25) WITHIN GROUP (ORDER BY p_retailprice) AS p25, percentile_disc(0.5) WITHIN GROUP (ORDER BY p_retailprice) AS d50 FROM part GROUP BY p_brand", "SELECT p_brand, median(p_retailprice) AS med, quantile_cont(p_retailprice, 0.9) AS p90, quantile_cont(p_retailprice, 0.25) AS p25, quantile_disc(p_retailprice, 0.5) AS d50 FROM part GROUP BY p_brand")
B.sql("stats_family", "SELECT p_brand, round(stddev(p_size), 6) AS s, round(stddev_pop(p_size), 6) AS sp, round(variance(p_size), 6) AS v, round(var_pop(p_size), 6) AS vp, round(corr(p_size, p_retailprice), 6) AS c, round(mean(p_size), 6) AS m FROM part GROUP BY p_brand")
B.sql("bool_aggs", "SELECT channel, bool_or(promo_code IS NULL) AS some_null, bool_and(status = 'PAID') AS all_paid, count_if(status = 'PLACED') AS placed, any(status = 'PAID') AS has_paid, every(order_id > 0) AS ok FROM ticket_orders GROUP BY channel", "SELECT channel, bool_or(promo_code IS NULL) AS some_null, bool_and(status = 'PAID') AS all_paid, count_if(status = 'PLACED')::BIGINT AS placed, bool_or(status = 'PAID') AS has_paid, bool_and(order_id > 0) AS ok FROM ticket_orders GROUP BY channel")
B.sql("string_agg_ordered", "SELECT n_regionkey, string_agg(n_name, '|') WITHIN GROUP (ORDER BY n_name) AS names, listagg(DISTINCT n_name, ',') WITHIN GROUP (ORDER BY n_name) AS again FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS again FROM nation GROUP BY n_regionkey")
B.sql("collect_sorted", "SELECT event_id, array_sort(collect_set(user_id)) AS users FROM (SELECT event_type AS event_id, user_id FROM events) GROUP BY event_id", "SELECT event_id, list_sort(list(DISTINCT user_id)) AS users FROM (SELECT event_type AS event_id, user_id FROM events) GROUP BY event_id")
B.sql("empty_global", "SELECT count(*) AS n, sum(l_quantity) AS s, max(l_shipdate) IS NULL AS none FROM lineitem WHERE l_quantity < 0")
B.sql("first_last_agg", "SELECT o_custkey, min_by(o_orderstatus, struct(o_orderdate, o_orderkey)) AS first_status, max_by(o_orderstatus, struct(o_orderdate, o_orderkey)) AS last_status FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS first_status, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status FROM orders GROUP BY o_custkey")
B.sql("distinct_aggs", "SELECT o_orderstatus, CAST(sum(DISTINCT year(o_orderdate)) AS BIGINT) AS years, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1", "SELECT o_orderstatus, CAST(sum(DISTINCT year(o_orderdate)) AS BIGINT) AS years, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
B.sql("approx_distinct", "SELECT approx_count_distinct(l_partkey) AS n, percentile_approx(l_quantity, 0.5) AS m FROM lineitem", None)

# --- windows
_O = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
B.sql("row_number_rank", f"SELECT o_orderkey, CAST(row_number() OVER ({_O}) AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY year(o_orderdate)) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY year(o_orderdate)) AS BIGINT) AS dr FROM orders")
B.sql("ntile_op", "SELECT p_partkey, CAST(ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS BIGINT) AS q FROM part")
B.sql("percent_rank_cume", "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS pr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS cd FROM part")
B.sql("lag_lead_default", f"SELECT o_orderkey, lag(o_orderkey, 1, -1) OVER ({_O}) AS prev, lead(o_orderkey, 2) OVER ({_O}) AS next2 FROM orders")
B.sql("lag_ignore_nulls", "SELECT event_id, snapshot_date, seats_remaining, lag(seats_remaining) IGNORE NULLS OVER (PARTITION BY event_id ORDER BY snapshot_date, seats_remaining) AS before FROM seat_inventory WHERE event_id IS NOT NULL AND snapshot_date IS NOT NULL", "SELECT event_id, snapshot_date, seats_remaining, lag(seats_remaining IGNORE NULLS) OVER (PARTITION BY event_id ORDER BY snapshot_date, seats_remaining NULLS FIRST) AS before FROM seat_inventory WHERE event_id IS NOT NULL AND snapshot_date IS NOT NULL")
_F = f"({_O} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
B.sql("first_last_nth", f"SELECT o_orderkey, first_value(o_orderkey) OVER {_F} AS f, last_value(o_orderkey) OVER {_F} AS l, nth_value(o_orderkey, 2) OVER {_F} AS n2 FROM orders")
B.sql("running_rows", f"SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER ({_O} ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS s FROM orders")
B.sql("running_range_peers", "SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS s FROM part", "SELECT p_partkey, (sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size))::BIGINT AS s FROM part")
B.sql("moving_avg", f"SELECT o_orderkey, round(avg(o_totalprice) OVER ({_O} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS a FROM orders")
B.sql("following_frame", f"SELECT o_orderkey, count(*) OVER ({_O} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n FROM orders")
B.sql("range_numeric", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM part")
B.sql("range_interval", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW) AS n FROM orders", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW) AS n FROM orders")
B.sql("window_over_agg", "SELECT o_orderstatus, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM orders GROUP BY o_orderstatus")
B.sql("share_of_total", "SELECT channel, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ticket_orders GROUP BY channel", "SELECT channel, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM ticket_orders GROUP BY channel")
B.sql("named_window", f"SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, count(*) OVER (w ROWS UNBOUNDED PRECEDING) AS n FROM orders WINDOW w AS ({_O})")
B.sql("count_distinct_over", "SELECT order_id, customer_id, count(DISTINCT event_id) OVER (PARTITION BY customer_id) AS events FROM ticket_orders")
B.sql("sum_distinct_over", "SELECT order_id, line_no, sum(DISTINCT quantity) OVER (PARTITION BY order_id) AS s FROM order_items", "SELECT order_id, line_no, (sum(DISTINCT quantity) OVER (PARTITION BY order_id))::BIGINT AS s FROM order_items")
B.sql("distinct_over_types", "SELECT l_orderkey, l_linenumber, sum(DISTINCT 9007199254740993 + l_linenumber) OVER (PARTITION BY l_orderkey) AS big, CAST(sum(DISTINCT CAST(l_tax AS DECIMAL(12,2))) OVER (PARTITION BY l_orderkey) AS STRING) AS tax, CAST(avg(DISTINCT l_linenumber) OVER (PARTITION BY l_suppkey) AS DOUBLE) AS mean, count(DISTINCT l_partkey) OVER (PARTITION BY l_suppkey) AS parts FROM lineitem", "SELECT l_orderkey, l_linenumber, (sum(DISTINCT 9007199254740993 + l_linenumber) OVER (PARTITION BY l_orderkey))::BIGINT AS big, CAST(sum(DISTINCT CAST(l_tax AS DECIMAL(12,2))) OVER (PARTITION BY l_orderkey) AS VARCHAR) AS tax, avg(DISTINCT l_linenumber) OVER (PARTITION BY l_suppkey) AS mean, count(DISTINCT l_partkey) OVER (PARTITION BY l_suppkey) AS parts FROM lineitem")
B.sql("distinct_over_running", f"SELECT o_orderkey, count(DISTINCT o_orderpriority) OVER ({_O}) AS kinds, count(DISTINCT o_orderstatus) OVER (PARTITION BY o_custkey) * 10 AS tens FROM orders", f"SELECT o_orderkey, count(DISTINCT o_orderpriority) OVER ({_O} RANGE UNBOUNDED PRECEDING) AS kinds, count(DISTINCT o_orderstatus) OVER (PARTITION BY o_custkey) * 10 AS tens FROM orders")
B.sql("filter_over", "SELECT order_id, count(*) FILTER (WHERE status = 'PAID') OVER (PARTITION BY customer_id) AS paid FROM ticket_orders")
B.sql("qualify_latest", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey)")
B.sql("qualify_having", "SELECT customer_id, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS rk FROM ticket_orders GROUP BY customer_id HAVING count(*) > 3 QUALIFY rk <= 10 ORDER BY rk, customer_id", "SELECT customer_id, count(*) AS n, rank() OVER (ORDER BY count(*) DESC)::INT AS rk FROM ticket_orders GROUP BY customer_id HAVING count(*) > 3 QUALIFY rk <= 10")
B.sql("top_n_per_group", "SELECT p_brand AS brand, l_partkey AS sku, CAST(sum(l_quantity) AS BIGINT) AS pieces, CAST(rank() OVER (PARTITION BY p_brand ORDER BY sum(l_quantity) DESC, l_partkey) AS BIGINT) AS place FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand, l_partkey QUALIFY place <= 4")

# --- CTEs and recursion
B.sql("cte_chain", "WITH a AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY 1), b AS (SELECT c_nationkey, s FROM a JOIN customer ON c_custkey = o_custkey) SELECT c_nationkey, CAST(sum(s) AS DOUBLE) AS total FROM b GROUP BY 1")
B.sql("recursive_numbers", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 90) SELECT n FROM t")
_TREE = "WITH RECURSIVE t(id, depth, path) AS (SELECT s_suppkey, 0, CAST(s_suppkey AS {s}) FROM supplier WHERE s_suppkey = 1 UNION ALL SELECT s_suppkey, depth + 1, concat(path, '/', CAST(s_suppkey AS {s})) FROM supplier JOIN t ON s_suppkey {div} 2 = t.id) SELECT id, depth, path FROM t"
B.sql("recursive_tree", _TREE.format(s="STRING", div="DIV"), _TREE.format(s="VARCHAR", div="//"))


@B.df("recursive_union_distinct", "WITH RECURSIVE e AS (SELECT s_suppkey AS a, (s_suppkey * 7) % 50 AS b FROM supplier), t AS (SELECT 1::BIGINT AS id UNION SELECT b FROM e JOIN t ON a = id) SELECT id FROM t")
def recursive_union_distinct(spark, d):
    from tesseral.operators.recursion import fixpoint

    edges = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), ((F.col("s_suppkey") * 7) % 50).alias("b"))
    return fixpoint(spark.range(1, 2), lambda new: new.join(edges, F.col("id") == F.col("a")).select(F.col("b").alias("id")))


B.sql("recursive_sql_distinct", "WITH RECURSIVE hop(a, b) AS (SELECT s_suppkey, (s_suppkey * 7 + 3) % 60 FROM supplier), seen(id) AS (SELECT 1L UNION SELECT b FROM hop JOIN seen ON a = id) SELECT id FROM seen", "WITH RECURSIVE hop(a, b) AS (SELECT s_suppkey, (s_suppkey * 7 + 3) % 60 FROM supplier), seen(id) AS (SELECT 1::BIGINT UNION SELECT b FROM hop JOIN seen ON a = id) SELECT id FROM seen")
B.sql("recursive_500_levels", "WITH RECURSIVE c(n, s) AS (SELECT 1, 1L UNION ALL SELECT n + 1, s + n + 1 FROM c WHERE n < 500) SELECT n, s FROM c", "WITH RECURSIVE c(n, s) AS (SELECT 1, 1::BIGINT UNION ALL SELECT n + 1, s + n + 1 FROM c WHERE n < 500) SELECT n, s FROM c")
B.sql("recursive_aggregate_step", "WITH RECURSIVE c(n, best) AS (SELECT 0, max(p_retailprice) FROM part UNION ALL SELECT max(c.n) + 1, max(p.p_retailprice) FROM c JOIN part p ON p.p_retailprice < c.best WHERE c.n < 6 GROUP BY c.n) SELECT n, best FROM c", "SELECT (row_number() OVER (ORDER BY best DESC) - 1)::INT AS n, best FROM (SELECT DISTINCT p_retailprice AS best FROM part ORDER BY best DESC LIMIT 7)")
B.sql("recursive_outer_step", "WITH RECURSIVE up(id, k, found) AS (SELECT n_nationkey, 0, true FROM nation WHERE n_nationkey = 1 UNION ALL SELECT coalesce(n.n_nationkey, -1), up.k + 1, n.n_nationkey IS NOT NULL FROM up LEFT JOIN nation n ON n.n_nationkey = up.id * 2 WHERE up.k < 7 AND up.id > 0) SELECT id, k, found FROM up", "SELECT * FROM (VALUES (1, 0, true), (2, 1, true), (4, 2, true), (8, 3, true), (16, 4, true), (-1, 5, false)) AS t(id, k, found)")
B.sql("exists_two_levels", "SELECT s.s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_totalprice > s.s_acctbal * 40))", "SELECT DISTINCT s_suppkey FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey WHERE o_totalprice > s_acctbal * 40")

# --- forms of the dialect that the queries above don't use
B.sql("like_escape", "SELECT s, s LIKE '5!%%' ESCAPE '!' AS pct, s NOT LIKE '%!_%' ESCAPE '!' AS no_bar, s ILIKE 'A#%b' ESCAPE '#' AS il FROM VALUES ('5% off'), ('50 off'), ('a_b'), ('a%B'), (NULL) AS t(s)", "SELECT s, s LIKE '5!%%' ESCAPE '!' AS pct, s NOT LIKE '%!_%' ESCAPE '!' AS no_bar, s ILIKE 'A#%b' ESCAPE '#' AS il FROM (VALUES ('5% off'), ('50 off'), ('a_b'), ('a%B'), (NULL)) AS t(s)")
B.sql("adjacent_literals", "SELECT 'one ' 'two' AS a, \"it's\" AS b, 'x' /* gap */ 'y' AS c", "SELECT 'one two' AS a, 'it''s' AS b, 'xy' AS c")
B.sql("current_user_op", "SELECT current_user AS a, current_user() AS b", "SELECT 'lab_user' AS a, 'lab_user' AS b")
B.sql("respect_nulls", "SELECT event_id, snapshot_date, first_value(seats_remaining) RESPECT NULLS OVER w AS f, last_value(seats_remaining) IGNORE NULLS OVER w AS l FROM (SELECT DISTINCT event_id, snapshot_date, seats_remaining FROM seat_inventory WHERE event_id IS NOT NULL AND snapshot_date IS NOT NULL) WINDOW w AS (PARTITION BY event_id ORDER BY snapshot_date, seats_remaining ROWS UNBOUNDED PRECEDING)", "SELECT event_id, snapshot_date, first_value(seats_remaining) OVER w AS f, last_value(seats_remaining IGNORE NULLS) OVER w AS l FROM (SELECT DISTINCT event_id, snapshot_date, seats_remaining FROM seat_inventory WHERE event_id IS NOT NULL AND snapshot_date IS NOT NULL) WINDOW w AS (PARTITION BY event_id ORDER BY snapshot_date, seats_remaining NULLS FIRST ROWS UNBOUNDED PRECEDING)")
B.sql("minus_op", "SELECT l_partkey FROM lineitem WHERE l_quantity > 45 MINUS SELECT l_partkey FROM lineitem WHERE l_quantity < 5", "SELECT l_partkey FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 5")
B.sql("minus_all", "SELECT l_suppkey FROM lineitem WHERE l_quantity > 45 MINUS ALL SELECT l_suppkey FROM lineitem WHERE l_quantity < 5", "SELECT l_suppkey FROM lineitem WHERE l_quantity > 45 EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_quantity < 5")
B.sql("limit_all", "SELECT s_suppkey FROM supplier ORDER BY s_acctbal LIMIT ALL OFFSET 95", "SELECT s_suppkey FROM supplier ORDER BY s_acctbal OFFSET 95")
B.sql("with_cube", "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY p_brand, p_size WITH CUBE", "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_size)")
B.sql("group_mixed_rollup", "SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY o_orderstatus, ROLLUP (o_orderpriority, year(o_orderdate))", "SELECT o_orderstatus, o_orderpriority, year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY o_orderstatus, ROLLUP (o_orderpriority, year(o_orderdate))")
B.sql("group_by_alias", "SELECT l_partkey DIV 10 AS tens, count(*) AS n FROM lineitem GROUP BY tens", "SELECT (l_partkey // 10)::BIGINT AS tens, count(*) AS n FROM lineitem GROUP BY 1")
B.sql("order_dependent_aggs", "SELECT p_brand, first(p_size) AS f, last(p_size) AS l, any_value(p_size) AS a, first_value(p_size) AS fv, last_value(p_size) AS lv, array_sort(array_agg(p_size)) AS g, some(p_size > 49) AS s, round(std(p_size), 6) AS sd, round(stddev_samp(p_size), 6) AS ss, round(var_samp(p_size), 6) AS vs FROM (SELECT p_brand, max(p_size) OVER (PARTITION BY p_brand) AS p_size FROM part UNION ALL SELECT p_brand, NULL FROM part WHERE 1 = 0) GROUP BY p_brand", "SELECT p_brand, max(m) AS f, max(m) AS l, max(m) AS a, max(m) AS fv, max(m) AS lv, list(m) AS g, bool_or(m > 49) AS s, 0.0::DOUBLE AS sd, 0.0::DOUBLE AS ss, 0.0::DOUBLE AS vs FROM (SELECT p_brand, max(p_size) OVER (PARTITION BY p_brand) AS m FROM part) GROUP BY p_brand")
B.sql("samples_stats", "SELECT o_custkey, round(std(o_totalprice), 4) AS a, round(stddev_samp(o_totalprice), 4) AS b, round(var_samp(o_totalprice), 2) AS c FROM orders GROUP BY o_custkey HAVING count(*) > 1", "SELECT o_custkey, round(stddev_samp(o_totalprice), 4) AS a, round(stddev_samp(o_totalprice), 4) AS b, round(var_samp(o_totalprice), 2) AS c FROM orders GROUP BY o_custkey HAVING count(*) > 1")
B.sql("over_distribute_sort", "SELECT o_orderkey, CAST(row_number() OVER (DISTRIBUTE BY o_custkey SORT BY o_orderdate DESC, o_orderkey) AS BIGINT) AS rn, sum(DISTINCT year(o_orderdate)) OVER (DISTRIBUTE BY o_custkey) AS years FROM orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn, (sum(DISTINCT year(o_orderdate)) OVER (PARTITION BY o_custkey))::BIGINT AS years FROM orders")


@B.df("as_of_join_op", "SELECT r.refund_id, r.order_id, r.refund_ts::DATE AS day, (SELECT max(p.payment_id) FROM payments p WHERE p.order_id = r.order_id AND p.paid_ts = (SELECT max(q.paid_ts) FROM payments q WHERE q.order_id = r.order_id AND q.paid_ts <= r.refund_ts)) AS payment_id FROM refunds r")
def as_of_join_op(spark, d):
    from tesseral.operators.temporal import as_of_join

    paid = table(spark, d, "payments").select("order_id", F.col("paid_ts").alias("refund_ts"), "payment_id")
    back = table(spark, d, "refunds").select("refund_id", "order_id", "refund_ts")
    return as_of_join(back, paid, ["order_id"], "refund_ts", ["payment_id"]).select("refund_id", "order_id", F.to_date("refund_ts").alias("day"), "payment_id")


@B.df("interval_join_op", "SELECT s_suppkey, count(*) AS n, min(o_orderkey) AS first FROM supplier JOIN orders ON o_orderkey BETWEEN s_suppkey * 90 AND s_suppkey * 90 + s_nationkey * 400 GROUP BY s_suppkey")
def interval_join_op(spark, d):
    from tesseral.operators.temporal import interval_join

    spans = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 90).alias("low"), (F.col("s_suppkey") * 90 + F.col("s_nationkey") * 400).alias("high"))
    pairs = interval_join(table(spark, d, "orders").select("o_orderkey"), spans, "o_orderkey", "low", "high")
    return pairs.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


# --- the same in the DataFrame API, where it reads better
@B.df("df_top_orders", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def df_top_orders(spark, d):
    from tesseral.operators.patterns import top_per_group

    return top_per_group(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2)


@B.df("df_rolling_days", "SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY epoch_us(o_orderdate) RANGE BETWEEN 7776000000000 PRECEDING AND CURRENT ROW) AS n FROM orders")
def df_rolling_days(spark, d):
    w = W.partitionBy("o_custkey").orderBy(F.unix_micros(F.col("o_orderdate").cast("timestamp"))).rangeBetween(-90 * 86400 * 1_000_000, 0)
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.count(F.lit(1)).over(w).alias("n"))


@B.df("df_salted_join", "SELECT l_orderkey, l_linenumber, l_partkey, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def df_salted_join(spark, d):
    from tesseral.operators.skew import salted_join

    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return salted_join(lines, orders, ["l_orderkey"])
