"""Changes to tables: INSERT, UPDATE, DELETE, MERGE and the loads built from them; the oracle gives the final state."""

from __future__ import annotations

from tesseral.queries.base import Book, used_tables
from tesseral.session import Engine, own_session, scratch
from tesseral.sources.readers import table

B = Book()
QUERIES, ORACLE = B.queries, B.oracle


def script(name: str, dialect: str, oracle: str) -> None:
    """Register a script that ends with a query; its tables live in a folder of their own beside the checkpoints."""

    def run(spark, d):
        spark = own_session(spark)
        for t in used_tables(dialect):
            table(spark, d, t).createOrReplaceTempView(t)
        return Engine(spark, store=scratch(spark, "tables")).sql(dialect)

    B.queries[name] = run
    B.oracle[name] = oracle


# the stock of a shop: every part with its price; the feed has new prices by the mean of the lines that sold it
_STOCK = "CREATE OR REPLACE TABLE w_stock AS SELECT p_partkey AS sku, p_size AS shelf, p_retailprice AS price, 0 AS gen FROM part;"
_STOCK_D = "w AS (SELECT p_partkey AS sku, p_size AS shelf, p_retailprice AS price, 0 AS gen FROM part)"
_FEED = "(SELECT l_partkey + 40 AS sku, max(l_linenumber) AS shelf, max(l_extendedprice) AS price, 1 AS gen FROM lineitem GROUP BY l_partkey)"
_FEED_D = f"f AS {_FEED}"
_ALL = " SELECT * FROM w_stock"

script("insert_select", _STOCK + "INSERT INTO w_stock (gen, sku) SELECT 9, sku + 1000000 FROM w_stock WHERE shelf < 10;" + _ALL, f"WITH {_STOCK_D} SELECT sku, shelf, price, gen FROM w UNION ALL SELECT sku + 1000000, NULL, NULL, 9 FROM w WHERE shelf < 10")
script("insert_overwrite", _STOCK + "INSERT OVERWRITE TABLE w_stock SELECT sku, shelf + 1, 1.5, 2 FROM w_stock WHERE shelf % 2 = 0;" + _ALL, f"WITH {_STOCK_D} SELECT sku, shelf + 1 AS shelf, 1.5::DOUBLE AS price, 2 AS gen FROM w WHERE shelf % 2 = 0")
script("update_where", _STOCK + "UPDATE w_stock w SET price = w.price * 2, gen = 5 WHERE w.sku IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49);" + _ALL, f"WITH {_STOCK_D} SELECT sku, shelf, CASE WHEN h THEN price * 2 ELSE price END AS price, CASE WHEN h THEN 5 ELSE gen END AS gen FROM (SELECT w.*, sku IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AS h FROM w)")
script("delete_where", _STOCK + "DELETE FROM w_stock WHERE price > 1400 OR shelf = 7;" + _ALL, f"WITH {_STOCK_D} SELECT * FROM w WHERE (price > 1400 OR shelf = 7) IS NOT TRUE")
script("truncate_reload", _STOCK + "TRUNCATE TABLE w_stock; INSERT INTO w_stock SELECT s_suppkey, s_nationkey, s_acctbal, 3 FROM supplier;" + _ALL, "SELECT s_suppkey AS sku, s_nationkey AS shelf, s_acctbal AS price, 3 AS gen FROM supplier")
script("merge_upsert", _STOCK + f"MERGE INTO w_stock AS have USING {_FEED} AS news ON news.sku = have.sku WHEN NOT MATCHED THEN INSERT * WHEN MATCHED THEN UPDATE SET *;" + _ALL, f"WITH {_STOCK_D}, {_FEED_D} SELECT * FROM f UNION ALL SELECT * FROM w WHERE sku NOT IN (SELECT sku FROM f)")
script(
    "merge_conditional",
    _STOCK + f"MERGE INTO w_stock AS have USING {_FEED} AS news ON news.sku = have.sku WHEN MATCHED AND news.price > 60000 THEN DELETE WHEN MATCHED AND news.price > have.price THEN UPDATE SET price = news.price, gen = have.gen + 7 WHEN NOT MATCHED AND news.shelf > 2 THEN INSERT (sku, gen) VALUES (news.sku, 3);" + _ALL,
    f"WITH {_STOCK_D}, {_FEED_D} SELECT sku, w.shelf, CASE WHEN f.price > w.price THEN f.price ELSE w.price END AS price, CASE WHEN f.price > w.price THEN 7 ELSE 0 END AS gen FROM w LEFT JOIN f USING (sku) WHERE (f.price > 60000) IS NOT TRUE UNION ALL SELECT sku, NULL, NULL, 3 FROM f WHERE sku NOT IN (SELECT sku FROM w) AND shelf > 2",
)
script("merge_delete_by_source", _STOCK + f"MERGE INTO w_stock AS have USING {_FEED} AS news ON news.sku = have.sku WHEN MATCHED THEN UPDATE SET gen = news.gen WHEN NOT MATCHED BY SOURCE AND have.sku % 2 = 1 THEN DELETE WHEN NOT MATCHED BY SOURCE THEN UPDATE SET gen = -1;" + _ALL, f"WITH {_STOCK_D}, {_FEED_D} SELECT w.sku, w.shelf, w.price, CASE WHEN f.sku IS NULL THEN -1 ELSE 1 END AS gen FROM w LEFT JOIN f USING (sku) WHERE f.sku IS NOT NULL OR w.sku % 2 = 0")
script("merge_schema_evolution", _STOCK + "MERGE WITH SCHEMA EVOLUTION INTO w_stock AS have USING (SELECT ps.s_suppkey AS sku, 99 AS shelf, ps.s_acctbal AS price, 4 AS gen, ps.s_name AS maker FROM supplier ps) AS news ON news.sku = have.sku WHEN MATCHED AND have.shelf > 25 THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *;" + _ALL, f"WITH {_STOCK_D} SELECT sku, CASE WHEN h THEN 99 ELSE shelf END AS shelf, CASE WHEN h THEN s_acctbal ELSE price END AS price, CASE WHEN h THEN 4 ELSE gen END AS gen, CASE WHEN h THEN s_name END AS maker FROM (SELECT *, shelf > 25 AND s_suppkey IS NOT NULL AS h FROM w LEFT JOIN supplier ON s_suppkey = sku) UNION ALL SELECT s_suppkey, 99, s_acctbal, 4, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT sku FROM w)")
script(
    "merge_dedupe_source",
    "CREATE OR REPLACE TABLE w_last (buyer BIGINT, bought DATE, spent DOUBLE); MERGE INTO w_last AS known USING (SELECT o_custkey AS buyer, CAST(o_orderdate AS DATE) AS bought, o_totalprice AS spent FROM orders QUALIFY dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1) AS seen ON known.buyer = seen.buyer WHEN NOT MATCHED THEN INSERT * WHEN MATCHED AND seen.bought > known.bought THEN UPDATE SET *; SELECT * FROM w_last",
    "SELECT o_custkey AS buyer, o_orderdate::DATE AS bought, o_totalprice AS spent FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1",
)
# every statement of where somebody stays is kept, with the day on which the next one begins; news move the ends of what is there
_PLACE = r"lower(trim(regexp_replace(city, '\\s+', ' ')))"
_SAID_D = r"SELECT DISTINCT customer_id AS who, lower(trim(regexp_replace(city, '\s+', ' ', 'g'))) AS place, {day} AS since FROM {t} WHERE customer_id IS NOT NULL AND {day} IS NOT NULL AND trim(regexp_replace(city, '\s+', ' ', 'g')) <> ''"
_SAID = f"SELECT DISTINCT customer_id AS who, {_PLACE} AS place, {{day}} AS since FROM {{t}} WHERE customer_id IS NOT NULL AND {{day}} IS NOT NULL AND {_PLACE} <> ''"
_ENDS = "lead(since) OVER (PARTITION BY who ORDER BY since, place)"
script(
    "scd2",
    f"CREATE OR REPLACE TABLE w_stays (who INT NOT NULL, place STRING, since DATE NOT NULL, until DATE); INSERT INTO w_stays SELECT *, {_ENDS} FROM ({_SAID.format(day='valid_from', t='dim_customer_city')}); CREATE TEMP VIEW w_news AS {_SAID.format(day='changed_on', t='city_changes')};"
    f" MERGE INTO w_stays AS old USING (SELECT *, {_ENDS} AS until FROM (SELECT who, place, since FROM w_stays WHERE who IN (SELECT who FROM w_news) UNION SELECT who, place, since FROM w_news)) AS new ON old.who = new.who AND old.since = new.since AND old.place = new.place WHEN MATCHED AND NOT old.until <=> new.until THEN UPDATE SET until = new.until WHEN NOT MATCHED THEN INSERT *; DROP VIEW w_news; SELECT * FROM w_stays",
    f"SELECT *, {_ENDS} AS until FROM ({_SAID_D.format(day='valid_from', t='dim_customer_city')} UNION {_SAID_D.format(day='changed_on', t='city_changes')})",
)
# loads by key range, with the mark in a table of its own; the last load finds nothing
_LOAD = "INSERT INTO w_facts SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey > (SELECT coalesce(max(upto), -1) FROM w_marks){cap}; INSERT INTO w_marks SELECT max(k) FROM w_facts;"
script(
    "incremental_load",
    "CREATE OR REPLACE TABLE w_facts (k BIGINT, buyer BIGINT, amount DOUBLE); CREATE OR REPLACE TABLE w_marks (upto BIGINT);" + _LOAD.format(cap=" AND o_orderkey <= (SELECT avg(o_orderkey) FROM orders)") + _LOAD.format(cap="") * 2 + "SELECT f.*, m.n AS loads FROM w_facts f CROSS JOIN (SELECT count(DISTINCT upto) AS n FROM w_marks) m",
    "SELECT o_orderkey AS k, o_custkey AS buyer, o_totalprice AS amount, 2::BIGINT AS loads FROM orders",
)
script("ctas_replace", "CREATE OR REPLACE TABLE w_sum AS SELECT o_custkey AS buyer, count(*) AS n FROM orders GROUP BY ALL; CREATE OR REPLACE TABLE w_sum AS WITH many AS (FROM w_sum SELECT * WHERE n > 2) SELECT buyer, n + 1 AS n FROM many; TABLE w_sum", "SELECT o_custkey AS buyer, count(*) + 1 AS n FROM orders GROUP BY 1 HAVING count(*) > 2")
script("dedupe_delete", "CREATE OR REPLACE TABLE w_pay AS SELECT payment_id, order_id, amount FROM payments WHERE payment_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY payment_id ORDER BY order_id, amount) = 1; DELETE FROM w_pay WHERE payment_id IN (SELECT payment_id FROM w_pay WHERE order_id IS NOT NULL AND amount IS NOT NULL QUALIFY row_number() OVER (PARTITION BY order_id, round(amount, 2) ORDER BY payment_id) > 1); SELECT payment_id, order_id FROM w_pay", "WITH w AS (SELECT payment_id, order_id, amount FROM payments WHERE payment_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY payment_id ORDER BY order_id NULLS FIRST, amount NULLS FIRST) = 1) SELECT payment_id, order_id FROM w WHERE payment_id NOT IN (SELECT payment_id FROM w WHERE order_id IS NOT NULL AND amount IS NOT NULL QUALIFY row_number() OVER (PARTITION BY order_id, round(amount, 2) ORDER BY payment_id) > 1)")

# --- definitions and utility statements
script("create_defaults", "CREATE TABLE w_def (id INT NOT NULL, tag STRING DEFAULT 'new', n INT DEFAULT 2 + 3, PRIMARY KEY (id)); INSERT INTO w_def (id) SELECT s_suppkey FROM supplier; INSERT INTO w_def VALUES (0, DEFAULT, 7), (-1, 'old', DEFAULT); SELECT * FROM w_def", "SELECT s_suppkey::INT AS id, 'new' AS tag, 5 AS n FROM supplier UNION ALL SELECT 0, 'new', 7 UNION ALL SELECT -1, 'old', 5")
script("create_if_not_exists", "CREATE TABLE w_one AS SELECT r_regionkey AS k FROM region; CREATE TABLE IF NOT EXISTS w_one (other STRING); CREATE VIEW IF NOT EXISTS w_seen AS SELECT k + 1 AS k FROM w_one; INSERT INTO w_one VALUES (50); CREATE VIEW IF NOT EXISTS w_seen AS SELECT 0 AS k; SELECT k FROM w_seen", "SELECT r_regionkey + 1 AS k FROM region UNION ALL SELECT 51")
script("drop_and_show", "CREATE TABLE w_a AS SELECT 1 AS x; CREATE TABLE w_b AS SELECT 2 AS x; CREATE VIEW w_c AS TABLE w_b; DROP TABLE w_a; DROP TABLE IF EXISTS w_a; USE main; CREATE SCHEMA IF NOT EXISTS tmp; SHOW TABLES", "SELECT * FROM (VALUES ('w_b', false), ('w_c', true)) AS t(tableName, isTemporary)")
script("show_views", "CREATE TABLE w_b AS SELECT 2 AS x; CREATE VIEW w_c AS TABLE w_b; CREATE OR REPLACE TEMP VIEW w_d AS SELECT 1 AS y; SHOW VIEWS", "SELECT * FROM (VALUES ('w_c', true), ('w_d', true)) AS t(tableName, isTemporary)")
script("describe_table", "CREATE TABLE w_t (id BIGINT NOT NULL, name STRING, at TIMESTAMP, tags ARRAY<STRING>); DESCRIBE TABLE w_t", "SELECT * FROM (VALUES ('id', 'bigint', false), ('name', 'string', true), ('at', 'timestamp', true), ('tags', 'array<string>', true)) AS t(col_name, data_type, nullable)")
script("explain_statement", "CREATE TABLE w_t AS SELECT 1 AS x; SELECT 'explained' AS s; EXPLAIN SELECT * FROM w_t; SELECT count(*) AS n FROM w_t", "SELECT 1::BIGINT AS n")
