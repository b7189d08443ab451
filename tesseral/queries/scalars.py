"""Families of scalar functions, many columns to a query."""

from __future__ import annotations

from tesseral.queries.base import Book

B = Book()
QUERIES, ORACLE = B.queries, B.oracle

B.sql(
    "conditional_family",
    "SELECT customer_id, coalesce(loyalty_tier, 'none') AS a, nullif(country, 'GB') AS b, ifnull(email, '-') AS c, nvl(city, '-') AS d, nvl2(referred_by, 'yes', 'no') AS e, if(marketing_opt_in, 1, 0) AS f, iff(country = 'DE', 'de', 'x') AS g, isnull(email) AS h, isnotnull(email) AS i, zeroifnull(referred_by) AS j, nullifzero(customer_id % 3) AS k, greatest(customer_id, referred_by) AS l, least(customer_id, referred_by) AS m FROM customers",
    "SELECT customer_id, coalesce(loyalty_tier, 'none') AS a, nullif(country, 'GB') AS b, coalesce(email, '-') AS c, coalesce(city, '-') AS d, CASE WHEN referred_by IS NOT NULL THEN 'yes' ELSE 'no' END AS e, CASE WHEN marketing_opt_in THEN 1 ELSE 0 END AS f, CASE WHEN country = 'DE' THEN 'de' ELSE 'x' END AS g, email IS NULL AS h, email IS NOT NULL AS i, coalesce(referred_by, 0) AS j, nullif(customer_id % 3, 0) AS k, greatest(customer_id, referred_by) AS l, least(customer_id, referred_by) AS m FROM customers",
)
B.sql(
    "math_family",
    "SELECT p_partkey, abs(-p_size) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS b, CAST(ceiling(p_retailprice) AS BIGINT) AS b2, CAST(floor(p_retailprice) AS BIGINT) AS c, round(sqrt(p_size), 6) AS d, power(p_size, 2) AS e, pow(2, 3) AS e2, round(exp(p_size / 50), 6) AS f, round(ln(p_size), 6) AS g, round(log(2, p_size), 6) AS h, round(log(p_size), 6) AS h2, round(log10(p_size), 6) AS i, round(log2(p_size), 6) AS j, CAST(sign(p_size - 25) AS DOUBLE) AS k, CAST(signum(p_size - 25) AS DOUBLE) AS k2, mod(p_size, 7) AS l, pmod(-p_size, 7) AS m, try_divide(1, p_size - 1) AS n, try_add(p_size, 1) AS o, try_subtract(p_size, 1) AS p, try_multiply(p_size, 2) AS q, CAST(div(p_size, 4) AS BIGINT) AS r, round(pi(), 6) AS s, round(e(), 6) AS t, CAST(width_bucket(p_size, 0, 50, 5) AS BIGINT) AS u FROM part",
    "SELECT p_partkey, abs(-p_size) AS a, ceil(p_retailprice)::BIGINT AS b, ceil(p_retailprice)::BIGINT AS b2, floor(p_retailprice)::BIGINT AS c, round(sqrt(p_size), 6) AS d, pow(p_size, 2)::DOUBLE AS e, 8.0::DOUBLE AS e2, round(exp(p_size / 50.0::DOUBLE), 6) AS f, round(ln(p_size), 6) AS g, round(ln(p_size) / ln(2), 6) AS h, round(ln(p_size), 6) AS h2, round(log10(p_size), 6) AS i, round(log2(p_size), 6) AS j, sign(p_size - 25)::DOUBLE AS k, sign(p_size - 25)::DOUBLE AS k2, p_size % 7 AS l, ((-p_size % 7) + 7) % 7 AS m, CASE WHEN p_size <> 1 THEN 1.0::DOUBLE / (p_size - 1) END AS n, p_size + 1 AS o, p_size - 1 AS p, p_size * 2 AS q, (p_size // 4)::BIGINT AS r, round(pi(), 6) AS s, round(exp(1), 6) AS t, least(p_size // 10 + 1, 6)::BIGINT AS u FROM part",
)
B.sql(
    "rounding",
    "SELECT x, round(x, 2) AS r2, round(x) AS r0, bround(x, 1) AS b1, ceil(x, 1) AS c1, floor(x, 1) AS f1 FROM VALUES (CAST(2.675 AS DECIMAL(8,3))), (186.235), (-2.5), (0.05), (2.25) AS t(x)",
    "SELECT * FROM (VALUES (2.675::DECIMAL(8,3), 2.68, 3, 2.7, 2.7, 2.6), (186.235, 186.24, 186, 186.2, 186.3, 186.2), (-2.5, -2.50, -3, -2.5, -2.5, -2.5), (0.05, 0.05, 0, 0.0, 0.1, 0.0), (2.25, 2.25, 2, 2.2, 2.3, 2.2)) AS t(x, r2, r0, b1, c1, f1)",
)
B.sql(
    "string_basic",
    "SELECT customer_id, upper(city) AS a, ucase(city) AS a2, lower(full_name) AS b, lcase(full_name) AS b2, CAST(length(full_name) AS BIGINT) AS c, CAST(char_length(city) AS BIGINT) AS d, CAST(character_length(city) AS BIGINT) AS d2, substring(full_name, 2, 3) AS e, substr(full_name, 3) AS e2, left(city, 3) AS f, right(city, 2) AS g, concat(country, '-', city) AS h, concat_ws('/', country, loyalty_tier, city) AS i, replace(full_name, 'a', 'A') AS j, translate(country, 'GB', 'gb') AS k, CAST(instr(full_name, ' ') AS BIGINT) AS l, CAST(locate('a', full_name) AS BIGINT) AS m, CAST(position('o' IN city) AS BIGINT) AS n, repeat(country, 2) AS o, reverse(country) AS p, contains(city, 'ar') AS q, startswith(city, 'M') AS r, endswith(city, 'y') AS s, CAST(ascii(country) AS BIGINT) AS t, chr(65) AS u, CAST(len(city) AS BIGINT) AS v, country || ':' || city AS w, char(66) AS x FROM customers",
    "SELECT customer_id, upper(city) AS a, upper(city) AS a2, lower(full_name) AS b, lower(full_name) AS b2, length(full_name)::BIGINT AS c, length(city)::BIGINT AS d, length(city)::BIGINT AS d2, substring(full_name, 2, 3) AS e, substring(full_name, 3) AS e2, left(city, 3) AS f, right(city, 2) AS g, country || '-' || city AS h, concat_ws('/', country, loyalty_tier, city) AS i, replace(full_name, 'a', 'A') AS j, translate(country, 'GB', 'gb') AS k, instr(full_name, ' ')::BIGINT AS l, instr(full_name, 'a')::BIGINT AS m, instr(city, 'o')::BIGINT AS n, repeat(country, 2) AS o, reverse(country) AS p, contains(city, 'ar') AS q, starts_with(city, 'M') AS r, ends_with(city, 'y') AS s, ascii(country)::BIGINT AS t, 'A' AS u, length(city)::BIGINT AS v, country || ':' || city AS w, 'B' AS x FROM customers",
)
B.sql(
    "string_pad_trim",
    r"SELECT payment_id, trim(status) AS a, ltrim(status) AS b, rtrim(status) AS c, btrim(status) AS d, trim(status, '-') AS e, lpad(method, 6, '*') AS f, rpad(method, 6, '*') AS g, initcap(method) AS h, split_part(method, '_', 1) AS i, split_part(method, '_', -1) AS j FROM payments",
    r"SELECT payment_id, regexp_replace(status, '^\s+|\s+$', '', 'g') AS a, regexp_replace(status, '^\s+', '') AS b, regexp_replace(status, '\s+$', '') AS c, regexp_replace(status, '^\s+|\s+$', '', 'g') AS d, trim(status, '-') AS e, lpad(left(method, 6), 6, '*') AS f, rpad(left(method, 6), 6, '*') AS g, upper(method[1]) || substring(method, 2) AS h, split_part(method, '_', 1) AS i, split_part(method, '_', -1) AS j FROM payments",
)
B.sql(
    "regex_family",
    r"SELECT customer_id, regexp_extract(email, '^([^@]+)@', 1) AS a, regexp_replace(email, '[0-9]+', '#') AS b, regexp_like(email, 'example\\.(com|org)$') AS c, CAST(regexp_count(email, '[aeiou]') AS BIGINT) AS d, regexp_substr(email, '[0-9]+') AS e, regexp_extract_all(email, '([a-z]+)', 1) AS f, split(email, '[@.]') AS g, email RLIKE '^[a-z]' AS h FROM customers WHERE email IS NOT NULL",
    r"SELECT customer_id, regexp_extract(email, '^([^@]+)@', 1) AS a, regexp_replace(email, '[0-9]+', '#', 'g') AS b, regexp_matches(email, 'example\.(com|org)$') AS c, len(regexp_extract_all(email, '[aeiou]'))::BIGINT AS d, nullif(regexp_extract(email, '[0-9]+'), '') AS e, regexp_extract_all(email, '([a-z]+)', 1) AS f, regexp_split_to_array(email, '[@.]') AS g, regexp_matches(email, '^[a-z]') AS h FROM customers WHERE email IS NOT NULL",
)
B.sql(
    "format_family",
    "SELECT p_partkey, format_number(p_retailprice, 2) AS a, format_string('%05d|%s|%.1f', p_size, p_brand, p_retailprice) AS b, format_number(2.5D, 0) AS c, md5(p_brand) AS d FROM part",
    "SELECT p_partkey, format('{:,.2f}', p_retailprice) AS a, printf('%05d|%s|%.1f', p_size, p_brand, p_retailprice) AS b, '3' AS c, md5(p_brand) AS d FROM part",
)
B.sql("soundex_op", "SELECT soundex('Robert') AS a, soundex('Rupert') AS b", "SELECT 'R163' AS a, 'R163' AS b")
B.sql(
    "cast_matrix",
    "SELECT CAST('12' AS INT) AS a, CAST(12.9 AS INT) AS b, TRY_CAST('x' AS INT) AS c, '2026-01-31'::DATE AS d, CAST(true AS INT) AS e, CAST('yes' AS BOOLEAN) AS f, CAST(1.005 AS DECIMAL(4,2)) AS g, TRY_CAST('2026-02-30' AS DATE) AS h, CAST(DATE'2026-01-01' AS STRING) AS i, CAST('1e3' AS DOUBLE) AS j, typeof(CAST(1 AS BIGINT)) AS k, try_to_timestamp('nope') IS NULL AS l, TRY_CAST('300' AS TINYINT) AS m",
    "SELECT 12 AS a, 12 AS b, NULL::INT AS c, DATE '2026-01-31' AS d, 1 AS e, true AS f, 1.01::DECIMAL(4,2) AS g, NULL::DATE AS h, '2026-01-01' AS i, 1000.0::DOUBLE AS j, 'bigint' AS k, true AS l, NULL::TINYINT AS m",
)
B.sql(
    "date_parts",
    "SELECT o_orderkey, year(o_orderdate) AS a, quarter(o_orderdate) AS b, month(o_orderdate) AS c, day(o_orderdate) AS d, dayofmonth(o_orderdate) AS d2, dayofweek(o_orderdate) AS e, weekday(o_orderdate) AS f, dayofyear(o_orderdate) AS g, weekofyear(o_orderdate) AS h, hour(o_orderdate) AS i, minute(o_orderdate) AS j, second(o_orderdate) AS k, CAST(extract(YEAR FROM o_orderdate) AS INT) AS l, CAST(date_part('DOW', o_orderdate) AS INT) AS m FROM orders",
    "SELECT o_orderkey, year(o_orderdate)::INT AS a, quarter(o_orderdate)::INT AS b, month(o_orderdate)::INT AS c, day(o_orderdate)::INT AS d, day(o_orderdate)::INT AS d2, (dayofweek(o_orderdate) + 1)::INT AS e, (isodow(o_orderdate) - 1)::INT AS f, dayofyear(o_orderdate)::INT AS g, weekofyear(o_orderdate)::INT AS h, hour(o_orderdate)::INT AS i, minute(o_orderdate)::INT AS j, second(o_orderdate)::INT AS k, year(o_orderdate)::INT AS l, (dayofweek(o_orderdate) + 1)::INT AS m FROM orders",
)
B.sql(
    "date_trunc_format",
    "SELECT o_orderkey, CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS a, CAST(date_trunc('WEEK', o_orderdate) AS DATE) AS b, trunc(o_orderdate, 'YEAR') AS c, date_format(o_orderdate, 'yyyy-MM-dd HH:mm') AS d, date_format(o_orderdate, 'EEEE') AS e, last_day(o_orderdate) AS f, next_day(o_orderdate, 'Mo') AS g, CAST(date_trunc('QUARTER', o_orderdate) AS DATE) AS h FROM orders",
    "SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS a, date_trunc('week', o_orderdate)::DATE AS b, date_trunc('year', o_orderdate)::DATE AS c, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS d, strftime(o_orderdate, '%A') AS e, last_day(o_orderdate::DATE) AS f, (date_trunc('week', o_orderdate) + INTERVAL 7 DAY)::DATE AS g, date_trunc('quarter', o_orderdate)::DATE AS h FROM orders",
)
B.sql(
    "date_arith",
    "SELECT o_orderkey, date_add(o_orderdate, 10) AS a, date_sub(o_orderdate, 10) AS b, add_months(o_orderdate, 1) AS c, dateadd(DAY, 3, CAST(o_orderdate AS DATE)) AS d, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS e, CAST(o_orderdate AS DATE) + 5 AS f, CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 WEEK AS DATE) AS g, date_format(o_orderdate + INTERVAL '2 hours' + INTERVAL 30 MINUTES, 'yyyy-MM-dd HH:mm') AS h, CAST(timestampadd(MONTH, 2, o_orderdate) AS DATE) AS i FROM orders",
    "SELECT o_orderkey, (o_orderdate::DATE + 10)::DATE AS a, (o_orderdate::DATE - 10)::DATE AS b, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE AS c, (o_orderdate::DATE + 3)::DATE AS d, (o_orderdate + INTERVAL 1 MONTH)::DATE AS e, (o_orderdate::DATE + 5)::DATE AS f, (o_orderdate::DATE - 7)::DATE AS g, strftime(o_orderdate + INTERVAL 150 MINUTE, '%Y-%m-%d %H:%M') AS h, (o_orderdate + INTERVAL 2 MONTH)::DATE AS i FROM orders",
)
B.sql(
    "datediff_units",
    "SELECT refund_id, CAST(datediff(TIMESTAMP'2026-07-01 00:00:00', refund_ts) AS BIGINT) AS a, CAST(datediff(HOUR, refund_ts, TIMESTAMP'2026-07-01 00:00:00') AS BIGINT) AS b, CAST(timestampdiff(DAY, refund_ts, TIMESTAMP'2026-07-01 00:00:00') AS BIGINT) AS c, CAST(date_diff(DATE'2026-07-01', CAST(refund_ts AS DATE)) AS BIGINT) AS d FROM refunds WHERE refund_ts IS NOT NULL",
    "SELECT refund_id, (DATE '2026-07-01' - refund_ts::DATE)::BIGINT AS a, trunc(epoch_us(TIMESTAMP '2026-07-01' - refund_ts) / 3600e6)::BIGINT AS b, trunc(epoch_us(TIMESTAMP '2026-07-01' - refund_ts) / 86400e6)::BIGINT AS c, (DATE '2026-07-01' - refund_ts::DATE)::BIGINT AS d FROM refunds WHERE refund_ts IS NOT NULL",
)
B.sql("months_between_op", "SELECT months_between(DATE'2026-03-31', DATE'2026-02-28') AS a, months_between(DATE'2026-03-15', DATE'2026-01-01') AS b", "SELECT 1.0::DOUBLE AS a, 2.4516129::DOUBLE AS b")
B.sql(
    "date_construct",
    "SELECT make_date(2026, 2, 28) AS a, date_format(make_timestamp(2026, 1, 2, 3, 4, 5), 'yyyy-MM-dd HH:mm:ss') AS b, unix_timestamp(TIMESTAMP'2026-01-01 00:00:00') AS c, from_unixtime(0, 'yyyy-MM-dd') AS d, date_format(timestamp_seconds(86400), 'yyyy-MM-dd') AS e, CAST(unix_date(DATE'1970-01-11') AS BIGINT) AS f, date_from_unix_date(20) AS g, to_date('31/12/2025', 'dd/MM/yyyy') AS h, date_format(to_timestamp('2026-05-06 07:08', 'yyyy-MM-dd HH:mm'), 'HH:mm') AS i, CAST(DATE'2026-01-01' + make_dt_interval(2) AS DATE) AS j",
    "SELECT DATE '2026-02-28' AS a, '2026-01-02 03:04:05' AS b, 1767225600::BIGINT AS c, '1970-01-01' AS d, '1970-01-02' AS e, 10::BIGINT AS f, DATE '1970-01-21' AS g, DATE '2025-12-31' AS h, '07:08' AS i, DATE '2026-01-03' AS j",
)
B.sql("interval_compare", "SELECT order_id FROM refunds WHERE refund_ts > TIMESTAMP'2026-06-30 00:00:00' - INTERVAL 30 DAYS", "SELECT order_id FROM refunds WHERE refund_ts > TIMESTAMP '2026-06-30' - INTERVAL 30 DAY")
B.sql("as_of_clock", "SELECT current_date() AS a, curdate() AS b, date_format(current_timestamp(), 'yyyy-MM-dd HH:mm') AS c, date_format(now(), 'HH') AS d, current_date AS e", "SELECT DATE '2026-07-01' AS a, DATE '2026-07-01' AS b, '2026-07-01 12:00' AS c, '12' AS d, DATE '2026-07-01' AS e")
B.sql("dateadd_types", "SELECT o_orderkey, typeof(dateadd(WEEK, 2, CAST(o_orderdate AS DATE))) AS a, dateadd(QUARTER, o_custkey % 3, CAST(o_orderdate AS DATE)) AS b, typeof(dateadd(HOUR, 1, o_orderdate)) LIKE 'timestamp%' AS c, dateadd(YEAR, -1, CAST(o_orderdate AS DATE)) AS d, CAST(dateadd(DAY, 1, o_orderdate) AS DATE) AS e FROM orders", "SELECT o_orderkey, 'date' AS a, (o_orderdate::DATE + to_months((o_custkey % 3)::INT * 3))::DATE AS b, true AS c, (o_orderdate::DATE - INTERVAL 1 YEAR)::DATE AS d, (o_orderdate + INTERVAL 1 DAY)::DATE AS e FROM orders")
B.sql("length_contains_arrays", "SELECT o_custkey, length(keys) AS n, contains(keys, first) AS has, contains(keys, -1) AS hasnt, length(CAST(first AS STRING)) AS digits, contains(CAST(first AS STRING), '1') AS one FROM (SELECT o_custkey, collect_list(o_orderkey) AS keys, min(o_orderkey) AS first FROM orders GROUP BY o_custkey)", "SELECT o_custkey, count(*)::INT AS n, true AS has, false AS hasnt, length(min(o_orderkey)::VARCHAR)::INT AS digits, contains(min(o_orderkey)::VARCHAR, '1') AS one FROM orders GROUP BY o_custkey")
B.sql("make_interval_op", "SELECT CAST(DATE'2026-01-31' + make_interval(0, 1, 0, 3) AS DATE) AS a, date_format(TIMESTAMP'2026-05-01 00:00:00' + make_interval(0, 0, 1, 1, 2, 3, 4), 'yyyy-MM-dd HH:mm:ss') AS b, CAST(DATE'2026-01-01' + make_ym_interval(1, 2) AS DATE) AS c", "SELECT (DATE '2026-01-31' + INTERVAL 1 MONTH + INTERVAL 3 DAY)::DATE AS a, '2026-05-09 02:03:04' AS b, DATE '2027-03-01' AS c")
