"""Arrays, maps, structs, lambdas, generators and JSON."""

from __future__ import annotations

from tesseral.queries.base import Book

B = Book()
QUERIES, ORACLE = B.queries, B.oracle

_CART = "(SELECT order_id, sort_array(collect_list(struct(line_no, quantity, unit_price))) AS items, sort_array(collect_list(quantity)) AS q FROM (SELECT DISTINCT order_id, line_no, quantity, unit_price FROM order_items) GROUP BY order_id)"
_DUCK = "(SELECT order_id, list({'line_no': line_no, 'quantity': quantity, 'unit_price': unit_price} ORDER BY line_no) AS items, list_sort(list(quantity)) AS q FROM (SELECT DISTINCT order_id, line_no, quantity, unit_price FROM order_items) GROUP BY order_id)"

B.sql("explode_op", f"SELECT order_id, x.line_no, x.quantity FROM {_CART} LATERAL VIEW explode(items) t AS x", "SELECT DISTINCT order_id, line_no, quantity FROM (SELECT DISTINCT order_id, line_no, quantity, unit_price FROM order_items)")
B.sql("explode_outer_op", f"SELECT order_id, v FROM {_CART} LATERAL VIEW OUTER explode(filter(q, x -> x > 3)) big AS v", f"SELECT order_id, unnest(CASE WHEN len(f) = 0 THEN [NULL] ELSE f END) AS v FROM (SELECT order_id, list_filter(q, lambda x: x > 3) AS f FROM {_DUCK})")
B.sql("posexplode_op", f"SELECT order_id, pos, v FROM {_CART} LATERAL VIEW posexplode(q) t AS pos, v", f"SELECT order_id, (unnest(range(len(q))))::INT AS pos, unnest(q) AS v FROM {_DUCK}")
B.sql("posexplode_outer_op", f"SELECT order_id, pos, v FROM {_CART} LATERAL VIEW posexplode_outer(filter(q, x -> x % 2 = 0)) even AS pos, v", f"SELECT order_id, unnest(CASE WHEN len(f) = 0 THEN [NULL] ELSE range(len(f)) END)::INT AS pos, unnest(CASE WHEN len(f) = 0 THEN [NULL] ELSE f END) AS v FROM (SELECT order_id, list_filter(q, lambda x: x % 2 = 0) AS f FROM {_DUCK})")
B.sql("inline_op", f"SELECT order_id, inline(items) FROM {_CART}", "SELECT DISTINCT order_id, line_no, quantity, unit_price FROM order_items")
B.sql("inline_outer_op", f"SELECT order_id, inline_outer(filter(items, x -> x.quantity > 4)) FROM {_CART}", "SELECT o.order_id, l.line_no, l.quantity, l.unit_price FROM (SELECT DISTINCT order_id FROM order_items) o LEFT JOIN (SELECT DISTINCT order_id, line_no, quantity, unit_price FROM order_items WHERE quantity > 4) l ON l.order_id IS NOT DISTINCT FROM o.order_id")
B.sql("map_explode", "SELECT p_partkey, explode(map(p_brand, p_size, p_type, p_size + 1)) AS (k, v) FROM part", "SELECT p_partkey, p_brand AS k, p_size AS v FROM part UNION ALL SELECT p_partkey, p_type, p_size + 1 FROM part")
B.sql("lateral_view_chain", "SELECT r_regionkey, x, y FROM region LATERAL VIEW explode(transform(sequence(0, r_regionkey), i -> sequence(i, r_regionkey))) runs AS run LATERAL VIEW explode(run) steps AS y LATERAL VIEW explode(array(r_name)) names AS x", "SELECT r_regionkey, r_name AS x, unnest(range(i::BIGINT, r_regionkey + 1))::INT AS y FROM (SELECT *, unnest(range(0, r_regionkey + 1)) AS i FROM region)")
B.sql(
    "transform_filter",
    f"SELECT order_id, transform(q, x -> x * 10) AS a, filter(q, x -> x > 1) AS b, transform(q, (x, i) -> x + i) AS c, CAST(size(filter(items, x -> x.unit_price > 100)) AS BIGINT) AS d FROM {_CART}",
    f"SELECT order_id, list_transform(q, lambda x: x * 10) AS a, list_filter(q, lambda x: x > 1) AS b, list_transform(q, lambda x, i: (x + i - 1)::INT) AS c, len(list_filter(items, lambda x: x.unit_price > 100))::BIGINT AS d FROM {_DUCK}",
)
B.sql(
    "aggregate_hof",
    f"SELECT order_id, aggregate(q, CAST(0 AS BIGINT), (a, x) -> a + x) AS s, reduce(q, 1L, (a, x) -> a * x, a -> a + 1) AS p, exists(q, x -> x > 3) AS e, forall(q, x -> x > 0) AS f FROM {_CART}",
    f"SELECT order_id, list_sum(q)::BIGINT AS s, list_product(q)::BIGINT + 1 AS p, len(list_filter(q, lambda x: x > 3)) > 0 AS e, len(list_filter(q, lambda x: x > 0)) = len(q) AS f FROM {_DUCK}",
)
B.sql("zip_sort_hof", "SELECT zip_with(array(1, 2), array(10, 20, 30), (a, b) -> coalesce(a, 0) + b) AS z, array_sort(array(3, 1, 2), (a, b) -> b - a) AS s, map_values(map_filter(map('a', 1, 'b', 5), (k, v) -> v > 2)) AS f, map_values(transform_values(map('a', 1), (k, v) -> v + 1)) AS t", "SELECT [11, 22, 30] AS z, [3, 2, 1] AS s, [5] AS f, [2] AS t")
B.sql(
    "array_family",
    "SELECT CAST(size(a) AS BIGINT) AS n, CAST(cardinality(a) AS BIGINT) AS n2, CAST(array_size(a) AS BIGINT) AS n3, array_contains(a, 2) AS c, element_at(a, 1) AS e1, element_at(a, -1) AS e2, try_element_at(a, 9) AS e3, get(a, 0) AS g, a[1] AS i, CAST(array_position(a, 3) AS BIGINT) AS p, array_distinct(a) AS d, sort_array(a) AS s, sort_array(a, false) AS sd, array_join(a, '-') AS j, array_remove(a, 2) AS r, array_append(a, 9) AS ap, array_prepend(a, 0) AS pp, array_max(a) AS mx, array_min(a) AS mn, slice(a, 2, 2) AS sl, array_repeat('x', 2) AS rp, reverse(a) AS rv FROM VALUES (array(3, 2, 2, 5)) AS t(a)",
    "SELECT 4::BIGINT AS n, 4::BIGINT AS n2, 4::BIGINT AS n3, true AS c, 3 AS e1, 5 AS e2, NULL::INT AS e3, 3 AS g, 2 AS i, 1::BIGINT AS p, [3, 2, 5] AS d, [2, 2, 3, 5] AS s, [5, 3, 2, 2] AS sd, '3-2-2-5' AS j, [3, 5] AS r, [3, 2, 2, 5, 9] AS ap, [0, 3, 2, 2, 5] AS pp, 5 AS mx, 2 AS mn, [2, 2] AS sl, ['x', 'x'] AS rp, [5, 2, 2, 3] AS rv",
)
B.sql("array_set_ops", "SELECT array_union(a, b) AS u, array_intersect(a, b) AS i, array_except(a, b) AS e, arrays_overlap(a, b) AS o, flatten(array(a, NULL, b)) AS f, array_compact(array(1, NULL, 2)) AS c, array_sort(array(2, NULL, 1)) AS s, a || b AS cat, sequence(1, 7, 3) AS q FROM VALUES (array(1, 2, 2), array(2, 3)) AS t(a, b)", "SELECT [1, 2, 3] AS u, [2] AS i, [1] AS e, true AS o, [1, 2, 2, 2, 3] AS f, [1, 2] AS c, [NULL, 1, 2] AS s, [1, 2, 2, 2, 3] AS cat, [1, 4, 7] AS q")
B.sql("array_zip_sequence", f"SELECT order_id, transform(arrays_zip(q, transform(items, x -> x.line_no)), x -> concat_ws(':', x.q, x['1'])) AS z FROM {_CART}", f"SELECT order_id, list_transform(range(1, len(q) + 1), lambda i: concat_ws(':', q[i], items[i].line_no)) AS z FROM {_DUCK}")
B.sql("date_sequence", "SELECT l_orderkey, l_linenumber, transform(sequence(CAST(l_shipdate AS DATE), date_add(l_shipdate, l_linenumber * 2), INTERVAL 2 DAYS), x -> CAST(x AS STRING)) AS days FROM lineitem", "SELECT l_orderkey, l_linenumber, list_transform(range(0, l_linenumber + 1), lambda i: strftime(l_shipdate::DATE + (i * 2)::INT, '%Y-%m-%d')) AS days FROM lineitem")
B.sql(
    "map_family",
    "SELECT map_keys(m) AS k, map_values(m) AS v, m['a'] AS a, m['zz'] AS z, element_at(m, 'b') AS b, map_contains_key(m, 'a') AS h, map_keys(map_from_arrays(array('x'), array(1))) AS f, map_values(map_from_entries(array(struct('y', 2)))) AS g, map_entries(m)[0].value AS e, map_values(str_to_map('p:1,q:2', ',', ':')) AS s FROM VALUES (map('a', 1, 'b', 2)) AS t(m)",
    "SELECT ['a', 'b'] AS k, [1, 2] AS v, 1 AS a, NULL::INT AS z, 2 AS b, true AS h, ['x'] AS f, [2] AS g, 1 AS e, ['1', '2'] AS s",
)
B.sql("struct_family", "SELECT order_id, items.line_no AS lines, items[0].quantity AS q0, named_struct('a', 1, 'b', 'x').b AS n, struct(order_id, 'k').col2 AS s FROM " + _CART, f"SELECT order_id, list_transform(items, lambda x: x.line_no) AS lines, items[1].quantity AS q0, 'x' AS n, 'k' AS s FROM {_DUCK}")
B.sql("embedding_dots", "SELECT vec_id, round(aggregate(embedding, CAST(0 AS DOUBLE), (a, x) -> a + x * x), 3) AS norm2, CAST(size(embedding) AS BIGINT) AS n FROM embeddings", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 3) AS norm2, len(embedding)::BIGINT AS n FROM embeddings")
B.sql("json_get_path", "SELECT event_id, props:k AS k, CAST(get_json_object(props, '$.k') AS INT) AS n, props:none AS x FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k')::INT AS n, NULL::VARCHAR AS x FROM events")
B.sql("json_from_json", "SELECT event_id, from_json(props, 'k INT').k AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
B.sql("json_to_json", "SELECT order_id, line_no, to_json(named_struct('t', ticket_type, 'q', quantity)) AS j FROM order_items", "SELECT order_id, line_no, CAST(json_object('t', ticket_type, 'q', quantity) AS VARCHAR) AS j FROM order_items")
B.sql("json_keys", "SELECT CAST(json_array_length('[1,2,3]') AS BIGINT) AS n, json_object_keys('{\"a\":1,\"b\":2}') AS k, json_array_length('{}') AS bad, '{\"a\":[{\"b\":5}]}':a[0].b AS p", "SELECT 3::BIGINT AS n, ['a', 'b'] AS k, NULL::INT AS bad, '5' AS p")
B.sql("json_inline_items", f"SELECT order_id, inline(from_json(to_json(transform(items, x -> struct(x.line_no AS l, x.quantity AS n))), 'array<struct<l:int,n:int>>')) FROM {_CART}", "SELECT DISTINCT order_id, line_no AS l, quantity AS n FROM (SELECT DISTINCT order_id, line_no, quantity, unit_price FROM order_items)")
B.sql("json_bad_text", "SELECT p_partkey, from_json(CASE p_partkey % 3 WHEN 0 THEN concat('{\"s\":', p_size, '}') WHEN 1 THEN '{oops' END, 's INT') IS NULL AS none, from_json(CASE p_partkey % 3 WHEN 0 THEN concat('{\"s\":', p_size, '}') WHEN 1 THEN '{oops' END, 's INT').s AS s FROM part", "SELECT p_partkey, p_partkey % 3 <> 0 AS none, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS s FROM part")
