"""What the dialect refuses, by name; sources and sinks; comparison of results; streams with late rows and upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesseral.operators import compare
from tesseral.plans.errors import condition_of
from tesseral.queries.base import Book
from tesseral.session import Engine, own_session, scratch
from tesseral.sources import readers
from tesseral.sources.readers import table

B = Book()
QUERIES, ORACLE = B.queries, B.oracle

_T = "VALUES (1, 2) AS t(a, b)"
# The conditions the dialect raises, each with statements that it refuses so.
CONDITIONS = {
    "names": {
        "AMBIGUOUS_REFERENCE": [f"SELECT a FROM {_T} JOIN (SELECT 1 AS a) u ON t.a = u.a"],
        "CANNOT_RESOLVE_STAR_EXPAND": [f"SELECT zz.* FROM {_T}"],
        "COLUMN_ALREADY_EXISTS": ["CREATE TABLE w_x AS SELECT 1 AS a, 2 AS A"],
        "FIELD_NOT_FOUND": ["SELECT named_struct('a', 1).zz"],
        "TABLE_OR_VIEW_NOT_FOUND": ["SELECT * FROM w_missing", "DROP TABLE w_missing"],
        "UNRESOLVED_COLUMN.WITH_SUGGESTION": [f"SELECT nope FROM {_T}", "CREATE TABLE w_c (a INT); INSERT INTO w_c (z) VALUES (1)"],
        "UNRESOLVED_ROUTINE": ["SELECT no_such(1)"],
        "UNRESOLVED_USING_COLUMN_FOR_JOIN": [f"SELECT * FROM {_T} JOIN (SELECT 1 AS c) u USING (zz)"],
        "UNSUPPORTED_DATATYPE": ["SELECT CAST(1 AS NOTATYPE)"],
        "PARSE_SYNTAX_ERROR": ["SELEC 1", "SELECT 'open", "SELECT (1"],
        "UNSUPPORTED_FEATURE": ["ALTER TABLE w_t ADD COLUMN y INT", "GRANT SELECT ON w_t TO u"],
        "INVALID_USAGE_OF_STAR_OR_REGEX": ["SELECT *", f"SELECT upper(*) FROM {_T}", f"SELECT a FROM {_T} WHERE a = *"],
        "WRONG_NUM_ARGS.WITHOUT_SUGGESTION": ["SELECT upper('a', 'b', 'c')"],
        "INVALID_LAMBDA_FUNCTION_CALL": ["SELECT upper(x -> x)", "SELECT x -> x"],
        "INVALID_DISTINCT": ["SELECT upper(DISTINCT 'a')"],
    },
    "groups": {
        "GROUPING_COLUMN_MISMATCH": [f"SELECT grouping(b) FROM {_T} GROUP BY ROLLUP (a)"],
        "GROUP_BY_AGGREGATE": [f"SELECT sum(b) FROM {_T} GROUP BY sum(b)", f"SELECT sum(b) AS s FROM {_T} GROUP BY s"],
        "GROUP_BY_POS_OUT_OF_RANGE": [f"SELECT a FROM {_T} GROUP BY 3"],
        "INVALID_WHERE_CONDITION": [f"SELECT a FROM {_T} WHERE sum(a) > 1"],
        "MISSING_AGGREGATION": [f"SELECT a, b, count(*) FROM {_T} GROUP BY a"],
        "MISSING_GROUP_BY": [f"SELECT a, count(*) FROM {_T}"],
        "NESTED_AGGREGATE_FUNCTION": [f"SELECT sum(count(*)) FROM {_T}"],
        "ORDER_BY_POS_OUT_OF_RANGE": [f"SELECT a FROM {_T} ORDER BY 9"],
        "UNSUPPORTED_GROUPING_EXPRESSION": [f"SELECT grouping(a) FROM {_T}"],
        "MISSING_ORDER_BY_FOR_WINDOW": [f"SELECT rank() OVER () FROM {_T}"],
        "MISSING_WINDOW_SPECIFICATION": [f"SELECT sum(a) OVER nope FROM {_T}"],
        "UNSUPPORTED_EXPR_FOR_WINDOW": [f"SELECT a FROM {_T} WHERE row_number() OVER (ORDER BY a) = 1"],
        "WINDOW_FUNCTION_WITHOUT_OVER_CLAUSE": [f"SELECT row_number() FROM {_T}"],
        "UNSUPPORTED_GENERATOR": [f"SELECT a FROM {_T} LATERAL VIEW upper('x') u AS y", f"SELECT a FROM {_T} WHERE explode(array(1)) = 1"],
        "UNSUPPORTED_GENERATOR.MULTI_GENERATOR": [f"SELECT explode(array(min(a))), explode(array(max(a))) FROM {_T}"],
        "UNSUPPORTED_GENERATOR.NOT_GENERATOR": ["SELECT explode(array(1)) + 1"],
    },
    "values": {
        "CANNOT_PARSE_TIMESTAMP": ["SELECT to_timestamp('x', 'yyyy-MM-dd')"],
        "CAST_INVALID_INPUT": ["SELECT CAST('x' AS INT)", "SELECT CAST('2026-02-30' AS DATE)"],
        "CAST_OVERFLOW": ["SELECT CAST(300 AS TINYINT)"],
        "DATATYPE_MISMATCH.BINARY_OP_DIFF_TYPES": ["SELECT array(1) + 1"],
        "DATATYPE_MISMATCH.UNEXPECTED_INPUT_TYPE": ["SELECT upper(array(1))"],
        "DATETIME_FIELD_OUT_OF_BOUNDS": ["SELECT make_date(2026, 13, 1)"],
        "DIVIDE_BY_ZERO": ["SELECT 1 / 0", "SELECT 1 % 0"],
        "INTERNAL_ERROR": [],
        "INVALID_ARRAY_INDEX": ["SELECT ARRAY[1][5]"],
        "INVALID_ARRAY_INDEX_IN_ELEMENT_AT": ["SELECT element_at(array(1), 5)"],
        "INVALID_EXTRACT_BASE_FIELD_TYPE": [f"SELECT a.x FROM {_T}"],
        "INVALID_INDEX_OF_ZERO": ["SELECT element_at(array(1), 0)"],
        "INVALID_INTERVAL_FORMAT": ["SELECT INTERVAL '5 parsecs'", "SELECT DATE'2026-01-01' + INTERVAL 3 FORTNIGHTS"],
        "INVALID_PARAMETER_VALUE.DATETIME_UNIT": ["SELECT dateadd(EON, 1, DATE'2026-01-01')", "SELECT extract(EON FROM DATE'2026-01-01')", "SELECT datediff(EON, DATE'2026-01-01', DATE'2026-01-02')"],
        "INVALID_PARAMETER_VALUE.PATTERN": ["SELECT 'a' RLIKE '('"],
        "INVALID_PARAMETER_VALUE.REGEX_GROUP_INDEX": ["SELECT regexp_extract('ab', '(a)', 5)"],
        "INVALID_PARAMETER_VALUE.SEQUENCE_STEP": ["SELECT sequence(1, 5, 0)"],
        "INVALID_PARAMETER_VALUE.START": ["SELECT slice(array(1, 2), 0, 1)"],
        "INVALID_SCHEMA.NON_STRING_LITERAL": ["SELECT from_json('{}', 5)"],
        "INVALID_SCHEMA.PARSE_ERROR": ["SELECT from_json('{}', 'a ((')"],
        "NUMERIC_VALUE_OUT_OF_RANGE": ["SELECT CAST(12345.678 AS DECIMAL(4,2))"],
    },
    "queries": {
        "DATATYPE_MISMATCH.INVALID_IN_SUBQUERY": ["SELECT 1 IN (SELECT 1, 2)"],
        "INVALID_INLINE_TABLE.NUM_COLUMNS_MISMATCH": ["SELECT * FROM VALUES (1), (1, 2) AS t(a)"],
        "INVALID_LIMIT_LIKE_EXPRESSION.IS_NEGATIVE": ["SELECT 1 LIMIT -1"],
        "INVALID_SUBQUERY_EXPRESSION.SCALAR_SUBQUERY_RETURN_MORE_THAN_ONE_OUTPUT_COLUMN": ["SELECT (SELECT 1, 2)"],
        "NUM_COLUMNS_MISMATCH": ["SELECT 1 UNION SELECT 1, 2"],
        "RECURSION_LEVEL_LIMIT_EXCEEDED": ["WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r) SELECT count(*) FROM r"],
        "SCALAR_SUBQUERY_TOO_MANY_ROWS": ["SELECT (SELECT a FROM VALUES (1), (2) AS t(a))"],
    },
    "tables": {
        "DELTA_MULTIPLE_SOURCE_ROW_MATCHING_TARGET_ROW_IN_MERGE": ["CREATE TABLE w_a AS SELECT 1 AS k; MERGE INTO w_a t USING (SELECT * FROM VALUES (1), (1) AS v(k)) s ON t.k = s.k WHEN MATCHED THEN DELETE"],
        "DELTA_NOT_NULL_CONSTRAINT_VIOLATED": ["CREATE TABLE w_b (k INT NOT NULL); INSERT INTO w_b VALUES (NULL)"],
        "EXPECT_TABLE_NOT_VIEW": ["CREATE VIEW w_v AS SELECT 1 AS a; INSERT INTO w_v VALUES (1)"],
        "INSERT_COLUMN_ARITY_MISMATCH": ["CREATE TABLE w_d (a INT, b INT); INSERT INTO w_d VALUES (1)"],
        "TABLE_OR_VIEW_ALREADY_EXISTS": ["CREATE TABLE w_e AS SELECT 1 AS a; CREATE TABLE w_e AS SELECT 2 AS a"],
        "WRONG_COMMAND_FOR_OBJECT_TYPE": ["CREATE VIEW w_w AS SELECT 1 AS a; DROP TABLE w_w"],
    },
}


def _refused(spark, statement: str) -> str:
    own = own_session(spark)
    try:
        Engine(own, store=scratch(own, "tables")).sql(statement).collect()
    except Exception as e:
        return condition_of(e)
    return "none"


def _conditions(family: str) -> None:
    cases = [(s, c) for c, statements in CONDITIONS[family].items() for s in statements]

    def run(spark, d):
        return spark.createDataFrame([(s, _refused(spark, s)) for s, _ in cases], "statement string, condition string")

    quote = lambda x: "'" + x.replace("'", "''") + "'"
    B.queries[f"conditions_{family}"] = run
    B.oracle[f"conditions_{family}"] = f"SELECT * FROM (VALUES {', '.join(f'({quote(s)}, {quote(c)})' for s, c in cases)}) AS t(statement, condition)"


for _family in CONDITIONS:
    _conditions(_family)


# --- sources and sinks: what is written is what is read

_PARTS = "p_partkey BIGINT, p_name STRING, p_size INT, p_retailprice DOUBLE"


def _round_trip(fmt: str, **options) -> None:
    def run(spark, d):
        path = f"{scratch(spark, 'files')}/part"
        readers.write(table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path, fmt)
        return readers.read(spark, path, fmt, _PARTS, **options)

    B.queries[f"source_{fmt}"] = run
    B.oracle[f"source_{fmt}"] = "SELECT p_partkey, p_name, p_size, p_retailprice FROM part"


for _fmt in ("parquet", "orc", "json", "csv"):
    _round_trip(_fmt)


@B.df("source_partitioned", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 12")
def source_partitioned(spark, d):
    """A filter on the folder's column prunes folders."""
    path = f"{scratch(spark, 'files')}/part"
    readers.write(table(spark, d, "part").select("p_partkey", "p_size"), path, partition_by=["p_size"])
    return readers.read(spark, path).where("p_size between 10 and 12")


@B.df("source_text", "SELECT r_name AS value FROM region")
def source_text(spark, d):
    path = f"{scratch(spark, 'files')}/lines"
    readers.write(table(spark, d, "region").select(F.col("r_name").alias("value")), path, "text")
    return readers.read(spark, path, "text")


@B.df("source_bucketed", "SELECT o_orderkey, o_totalprice, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def source_bucketed(spark, d):
    """Two tables bucketed alike are joined where they lie."""
    folder, tag = scratch(spark, "buckets"), uuid.uuid4().hex[:8]
    for name, keys in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        readers.write_bucketed(table(spark, d, name), f"w_{name}_{tag}", [keys], 8, f"{folder}/{name}")
    o, li = spark.table(f"w_orders_{tag}"), spark.table(f"w_lineitem_{tag}")
    return o.join(li, o.o_orderkey == li.l_orderkey).groupBy("o_orderkey", "o_totalprice").agg(F.count(F.lit(1)).alias("lines"))


@B.df("source_jdbc", "SELECT n_nationkey, n_name FROM nation")
def source_jdbc(spark, d):
    """Through the database that comes with Spark."""
    nations = table(spark, d, "nation").select("n_nationkey", F.col("n_name").cast("string"))
    url = readers.publish_derby(nations, "nations")
    return readers.read_jdbc(spark, url, "nations", "n_nationkey", 0, 25, 3)


# --- comparing results


@B.df("compare_results", "SELECT * FROM (VALUES ('same', true, ''), ('order', false, 'rows are in another order'), ('twice', false, 'rows repeated too often'), ('fewer', false, 'rows differ'), ('columns', false, '2 columns instead of 1'), ('types', true, '')) AS t(what, equal, reason)")
def compare_results(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    last = rows.agg(F.max("s_suppkey")).first()[0]
    cases = [
        ("same", compare.compare(rows, rows.orderBy("s_acctbal"))),
        ("order", compare.compare(rows.orderBy("s_suppkey"), rows.orderBy(F.desc("s_suppkey")), ordered=True)),
        ("twice", compare.compare(rows.unionByName(rows.where(F.col("s_suppkey") == last)), rows)),
        ("fewer", compare.compare(rows.where(F.col("s_suppkey") < last), rows)),
        ("columns", compare.compare(rows, rows.select("s_suppkey"))),
        ("types", compare.compare(rows, rows.select(F.col("s_suppkey").cast("decimal(20,0)"), F.col("s_acctbal").cast("decimal(20,2)")))),
    ]
    return spark.createDataFrame([(k, c.equal, c.reason) for k, c in cases], "what string, equal boolean, reason string")


@B.df("run_twice", "SELECT * FROM (VALUES ('insert', false), ('merge', true), ('overwrite', true)) AS t(what, idempotent)")
def run_twice(spark, d):
    changes = {
        "insert": "INSERT INTO w_n SELECT n_nationkey, n_name FROM nation",
        "merge": "MERGE INTO w_n t USING (SELECT n_nationkey + 3 AS k, n_name AS v FROM nation) s ON t.k = s.k WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *",
        "overwrite": "INSERT OVERWRITE w_n SELECT n_regionkey, max(n_name) FROM nation GROUP BY n_regionkey",
    }
    out = []
    for what, change in changes.items():
        own = own_session(spark)
        table(own, d, "nation").createOrReplaceTempView("nation")
        e = Engine(own, store=scratch(own, "tables"))
        e.execute("CREATE TABLE w_n AS SELECT n_nationkey AS k, n_name AS v FROM nation")
        out.append((what, compare.idempotent(lambda: e.execute(change), lambda: e.sql("SELECT * FROM w_n")).equal))
    return spark.createDataFrame(out, "what string, idempotent boolean")
