"""The SQL front end: rewrites, scripts, changes to tables, error names."""

from datetime import date

import pytest
from conftest import rows

from tesseral.operators import compare as cmp
from tesseral.operators.recursion import fixpoint
from tesseral.plans.errors import DialectError, condition_of
from tesseral.plans.lexer import split_script, tokens
from tesseral.plans.rewrite import rewrite

ONE = [
    ("SELECT 7 / 2, 7 DIV 2, -5 % 3", (3.5, 3, -2)),
    ("SELECT iff(1 < 2, 'a', 'b'), trim('xxaxx', 'x'), trim('\t a \n'), ltrim('\ta '), count_distinct(v) FROM VALUES (1), (1), (NULL) AS t(v)", ("a", "a", "a", "a ", 1)),
    ("SELECT array_sort(ARRAY[2, NULL, 1]), flatten(ARRAY[ARRAY[1], NULL]), arrays_overlap(ARRAY[1, NULL], ARRAY[2])", ([None, 1, 2], [1], False)),
    ("SELECT any_value(v), corr(v, 1) FROM VALUES (NULL), (3) AS t(v)", (3, None)),
    ("SELECT format_number(2.5D, 0), to_json(struct(1 AS a, NULL AS b))", ("3", '{"a":1,"b":null}')),
    ("SELECT j:a.b, j:c[1], t.j:a['b'], CAST('{\"x\":1}':x AS INT) FROM VALUES ('{\"a\":{\"b\":\"v\"},\"c\":[1,2]}') AS t(j)", ("v", "2", "v", 1)),
    ("SELECT current_date, current_date(), CAST(now() AS DATE), curdate()", (date(2026, 7, 1),) * 4),
    ("SELECT CAST(named_struct('a', 1) AS STRUCT<a:BIGINT>).a", (1,)),
    ("SELECT 'a;b' || \"c\" /* ; */ -- ;\n", ("a;bc",)),
    ("SELECT max(CASE WHEN 2 IN (1, NULL) THEN 1 END), count(*) FILTER (WHERE v > 1) FROM VALUES (1), (2) AS t(v)", (None, 1)),
]


@pytest.mark.parametrize("sql,want", ONE)
def test_expressions(engine, sql, want):
    (got,) = engine.sql(sql).collect()
    assert tuple(got) == want


T = "VALUES (1, 'a', 10), (1, 'b', 20), (2, 'a', 5), (2, 'c', NULL), (NULL, 'a', 1) AS t(k, s, v)"
MANY = [
    (f"SELECT k, s FROM {T} QUALIFY row_number() OVER (PARTITION BY k ORDER BY s DESC) = 1", [(None, "a"), (1, "b"), (2, "c")]),
    (f"SELECT k, s, row_number() OVER w AS rn FROM {T} WHERE k IS NOT NULL WINDOW w AS (PARTITION BY k ORDER BY s) QUALIFY rn = 2", [(1, "b", 2), (2, "c", 2)]),
    (f"SELECT DISTINCT k FROM {T} QUALIFY count(*) OVER (PARTITION BY k) = 2", [(1,), (2,)]),
    (f"SELECT k, sum(v) AS s FROM {T} GROUP BY ALL HAVING count(*) > 1 QUALIFY rank() OVER (ORDER BY sum(v) DESC) = 1", [(1, 30)]),
    (f"SELECT * FROM (SELECT k, v FROM {T} QUALIFY v = max(v) OVER (PARTITION BY k)) ORDER BY k LIMIT 2", [(None, 1), (1, 20)]),
    (f"WITH x AS (SELECT * FROM {T} QUALIFY row_number() OVER (ORDER BY s, k, v) <= 2) SELECT k, v FROM x UNION ALL SELECT k, v FROM {T} QUALIFY row_number() OVER (ORDER BY v DESC) = 1", [(None, 1), (1, 10), (1, 20)]),
    (f"SELECT s FROM {T} QUALIFY row_number() OVER (PARTITION BY k ORDER BY v) = 1 ORDER BY v DESC NULLS LAST, k LIMIT 1", [("a",)]),
    (f"SELECT k, count(DISTINCT s) OVER (PARTITION BY k) AS n, sum(DISTINCT v) OVER () AS t, count(*) FILTER (WHERE v > 5) OVER (PARTITION BY k) AS f FROM {T} WHERE k = 1", [(1, 2, 30, 2), (1, 2, 30, 2)]),
    (f"SELECT * EXCEPT (v) FROM {T} WHERE k = 2 EXCEPT SELECT 2, 'c'", [(2, "a")]),
    ("WITH RECURSIVE r(n) AS (SELECT 1 UNION SELECT (n * 2) % 7 FROM r) SELECT n FROM r", [(1,), (2,), (4,)]),
    ("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 300) SELECT max(n) FROM r", [(300,)]),
]


@pytest.mark.parametrize("sql,want", MANY)
def test_queries(engine, sql, want):
    assert rows(engine.sql(sql)) == want


def test_text_survives_the_lexer():
    sql = "SELECT `a``b`, 'it''s', \"x\\\"y\", 1.5e-3, a::INT -- c\n /* d */ FROM t WHERE x <=> y"
    assert "".join(t.text for t in tokens(sql)) == sql
    assert split_script("a; ;b 'x;y';-- z;\n") == ["a", "b 'x;y'"]
    assert rewrite("SELECT a FROM t") == "SELECT a FROM t"


ERRORS = [
    ("SELECT 1 / 0", "DIVIDE_BY_ZERO"), ("SELECT 1 % 0", "DIVIDE_BY_ZERO"), ("SELECT nope FROM VALUES (1) AS t(a)", "UNRESOLVED_COLUMN.WITH_SUGGESTION"), ("SELECT * FROM missing_table", "TABLE_OR_VIEW_NOT_FOUND"),
    ("SELECT CAST('x' AS INT)", "CAST_INVALID_INPUT"), ("SELECT CAST(300 AS TINYINT)", "CAST_OVERFLOW"), ("SELECT a, count(*) FROM VALUES (1) AS t(a)", "MISSING_GROUP_BY"), ("SELECT a, b, count(*) FROM VALUES (1, 2) AS t(a, b) GROUP BY a", "MISSING_AGGREGATION"),
    ("SELECT sum(count(*)) FROM VALUES (1) AS t(a)", "NESTED_AGGREGATE_FUNCTION"), ("SELECT rank() OVER () FROM VALUES (1) AS t(a)", "MISSING_ORDER_BY_FOR_WINDOW"), ("SELECT a FROM VALUES (1) AS t(a) WHERE row_number() OVER (ORDER BY a) = 1", "UNSUPPORTED_EXPR_FOR_WINDOW"),
    ("SELECT no_such(1)", "UNRESOLVED_ROUTINE"), ("SELECT ARRAY[1][5]", "INVALID_ARRAY_INDEX"), ("SELECT element_at(ARRAY[1], 0)", "INVALID_INDEX_OF_ZERO"), ("SELECT (SELECT a FROM VALUES (1), (2) AS t(a))", "SCALAR_SUBQUERY_TOO_MANY_ROWS"),
    ("SELECT 1 UNION SELECT 1, 2", "NUM_COLUMNS_MISMATCH"), ("SELECT a FROM VALUES (1) AS t(a) JOIN VALUES (1) AS u(a) ON t.a = u.a", "AMBIGUOUS_REFERENCE"), ("SELECT 'unclosed", "PARSE_SYNTAX_ERROR"), ("SELECT (1", "PARSE_SYNTAX_ERROR"), ("SELEC 1", "PARSE_SYNTAX_ERROR"),
    ("SELECT make_date(2026, 13, 1)", "DATETIME_FIELD_OUT_OF_BOUNDS"), ("SELECT sequence(1, 5, -1)", "INVALID_PARAMETER_VALUE.SEQUENCE_STEP"), ("SELECT 1 IN (SELECT 1, 2)", "DATATYPE_MISMATCH.INVALID_IN_SUBQUERY"), ("SELECT upper(DISTINCT 'a')", "INVALID_DISTINCT"),
    ("SELECT 1 LIMIT -1", "INVALID_LIMIT_LIKE_EXPRESSION.IS_NEGATIVE"), ("SELECT a FROM VALUES (1) AS t(a) ORDER BY 3", "ORDER_BY_POS_OUT_OF_RANGE"), ("DROP TABLE missing_table", "TABLE_OR_VIEW_NOT_FOUND"),
]


@pytest.mark.parametrize("sql,want", ERRORS)
def test_errors(engine, sql, want):
    with pytest.raises(Exception) as e:
        engine.sql(sql).collect()
    assert condition_of(e.value) == want


# --- tables

DDL = "CREATE TABLE dim (id INT NOT NULL, name STRING, tier VARCHAR(9) DEFAULT 'x', PRIMARY KEY (id)); INSERT INTO dim VALUES (1, 'a', 'A'), (2, 'b', 'B'), (3, 'c', 'C');"


def test_changes(engine):
    r = engine.execute(DDL + "INSERT INTO dim (name, id) SELECT 'd', '4'; UPDATE dim SET name = upper(name), tier = NULL WHERE id > 2; DELETE FROM dim d WHERE d.id IN (SELECT min(id) FROM dim)")
    assert [tuple(x.df.collect()[0]) if x.df is not None else None for x in r] == [None, (3, 3), (1, 1), (2,), (1,)]
    assert rows(engine.sql("SELECT * FROM dim")) == [(2, "b", "B"), (3, "C", None), (4, "D", None)]
    # each write is a version that can still be read
    assert engine.store.meta("dim").version == 5 and rows(engine.store.read("dim", 2)) == [(1, "a", "A"), (2, "b", "B"), (3, "c", "C")]
    assert rows(engine.sql("DESCRIBE dim")) == [("id", "int", False), ("name", "string", True), ("tier", "string", True)]
    engine.execute("CREATE VIEW v AS SELECT id FROM dim; TRUNCATE TABLE dim")
    assert rows(engine.sql("SELECT count(*) FROM dim")) == [(0,)]
    assert ("v", True) in rows(engine.sql("SHOW VIEWS")) and ("dim", False) in rows(engine.sql("SHOW TABLES"))


def test_deletes_with_nulls(engine):
    engine.execute("CREATE TABLE x AS SELECT * FROM VALUES (1), (2), (NULL) AS t(a); DELETE FROM x WHERE a > 1")
    assert rows(engine.sql("SELECT a FROM x")) == [(None,), (1,)]
    engine.execute("UPDATE x SET a = 9 WHERE a NOT IN (SELECT CAST(NULL AS INT))")
    assert rows(engine.sql("SELECT a FROM x")) == [(None,), (1,)]


def _fails(engine, sql, condition):
    with pytest.raises(DialectError) as e:
        engine.execute(sql)
    assert e.value.condition == condition


def test_what_tables_refuse(engine):
    engine.execute(DDL)
    _fails(engine, "INSERT INTO dim VALUES (NULL, 'x', 'y')", "DELTA_NOT_NULL_CONSTRAINT_VIOLATED")
    _fails(engine, "UPDATE dim SET id = NULL WHERE id = 1", "DELTA_NOT_NULL_CONSTRAINT_VIOLATED")
    _fails(engine, "INSERT INTO dim VALUES (1, 'x')", "INSERT_COLUMN_ARITY_MISMATCH")
    _fails(engine, "INSERT INTO dim (id, zz) VALUES (1, 'x')", "UNRESOLVED_COLUMN.WITH_SUGGESTION")
    _fails(engine, "INSERT INTO dim VALUES ('q', 'x', 'y')", "CAST_INVALID_INPUT")
    _fails(engine, "CREATE TABLE dim (a INT)", "TABLE_OR_VIEW_ALREADY_EXISTS")
    _fails(engine, "CREATE TABLE d2 AS SELECT 1 AS a, 2 AS A", "COLUMN_ALREADY_EXISTS")
    engine.execute("CREATE VIEW dv AS SELECT * FROM dim; CREATE TABLE IF NOT EXISTS dim (a INT)")
    _fails(engine, "INSERT INTO dv VALUES (1, 'a', 'b')", "EXPECT_TABLE_NOT_VIEW")
    _fails(engine, "DROP TABLE dv", "WRONG_COMMAND_FOR_OBJECT_TYPE")
    # nothing runs when a later statement can't be read; what came before a failing one stays
    _fails(engine, "DELETE FROM dim; SELECT 'oops", "PARSE_SYNTAX_ERROR")
    assert rows(engine.sql("SELECT count(*) FROM dim")) == [(3,)]
    _fails(engine, "DELETE FROM dim WHERE id = 1; INSERT INTO dim VALUES (1)", "INSERT_COLUMN_ARITY_MISMATCH")
    assert rows(engine.sql("SELECT count(*) FROM dim")) == [(2,)]


def _files(store, name):
    return set(store.files(store.meta(name)))


def test_untouched_files_stay(engine):
    engine.execute("CREATE TABLE f AS SELECT 1 AS k, 'a' AS v; INSERT INTO f VALUES (2, 'b'); INSERT INTO f VALUES (3, 'c')")
    first = _files(engine.store, "f")
    engine.execute("INSERT INTO f VALUES (4, 'd')")
    assert first < _files(engine.store, "f")
    before = _files(engine.store, "f")
    engine.execute("UPDATE f SET v = 'x' WHERE k = 2")
    assert len(before - _files(engine.store, "f")) == 1
    before = _files(engine.store, "f")
    engine.execute("DELETE FROM f WHERE k > 100; MERGE INTO f t USING (SELECT 9 AS k, 'n' AS v) s ON t.k = s.k WHEN NOT MATCHED THEN INSERT *")
    assert before < _files(engine.store, "f")
    before = _files(engine.store, "f")
    engine.execute("MERGE INTO f t USING (SELECT 3 AS k, 'm' AS v) s ON t.k = s.k WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *")
    assert len(before - _files(engine.store, "f")) == 1
    want = [(1, "a"), (2, "x"), (3, "m"), (4, "d"), (9, "n")]
    assert rows(engine.sql("SELECT * FROM f")) == want
    engine.store.compact("f")
    assert rows(engine.sql("SELECT * FROM f")) == want and len(engine.store.meta("f").segments) == 1


def test_two_writers_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from tesseral.sources.versioned import Store

    a = Store(spark, str(tmp_path / "s"))
    a.write("t", spark.createDataFrame([(0,)], "k int"))
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda k: Store(spark, str(tmp_path / "s")).append("t", spark.createDataFrame([(k,)], "k int")), range(1, 9)))
    assert rows(a.read("t")) == [(k,) for k in range(9)] and a.meta("t").version == 9
    # a change that rests on an older version doesn't undo what came since
    base = a.meta("t")
    a.append("t", spark.createDataFrame([(50,)], "k int"))
    with pytest.raises(DialectError) as e:
        a.replace_files("t", base, a.files(base), None)
    assert e.value.condition == "CONCURRENT_WRITE" and a.read("t").count() == 10


SRC = "(SELECT * FROM VALUES (2, 'bb', 'T'), (3, NULL, 'U'), (9, 'i', 'V') AS s(id, name, tier))"


@pytest.mark.parametrize(
    "clauses,counts,want",
    [
        ("WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *", (3, 2, 0, 1), [(1, "a", "A"), (2, "bb", "T"), (3, None, "U"), (9, "i", "V")]),
        ("WHEN MATCHED AND s.name IS NULL THEN DELETE WHEN MATCHED THEN UPDATE SET name = s.name || t.name", (2, 1, 1, 0), [(1, "a", "A"), (2, "bbb", "B")]),
        ("WHEN NOT MATCHED AND s.tier = 'Z' THEN INSERT * WHEN NOT MATCHED THEN INSERT (id, tier) VALUES (s.id * 10, lower(s.tier))", (1, 0, 0, 1), [(1, "a", "A"), (2, "b", "B"), (3, "c", "C"), (90, None, "v")]),
        ("WHEN MATCHED THEN DELETE WHEN NOT MATCHED BY SOURCE THEN UPDATE SET tier = 'gone'", (3, 1, 2, 0), [(1, "a", "gone")]),
        ("WHEN NOT MATCHED BY SOURCE AND t.id = 5 THEN DELETE", (0, 0, 0, 0), [(1, "a", "A"), (2, "b", "B"), (3, "c", "C")]),
        ("WHEN MATCHED AND s.name = 'none' THEN DELETE WHEN NOT MATCHED THEN INSERT *", (1, 0, 0, 1), [(1, "a", "A"), (2, "b", "B"), (3, "c", "C"), (9, "i", "V")]),
    ],
)
def test_merge(engine, clauses, counts, want):
    engine.execute(DDL)
    (r,) = engine.execute(f"MERGE INTO dim AS t USING {SRC} AS s ON t.id = s.id {clauses}")
    assert tuple(r.df.collect()[0]) == counts
    assert rows(engine.sql("SELECT * FROM dim")) == want


def test_merge_with_repeated_source_rows(engine):
    engine.execute(DDL)
    twice = "(SELECT * FROM VALUES (2, 'p', 'q'), (2, 'r', 's'), (8, 'n', 'n'), (8, 'n', 'n') AS s(id, name, tier))"
    _fails(engine, f"MERGE INTO dim t USING {twice} s ON t.id = s.id WHEN MATCHED AND 1 = 0 THEN DELETE", "DELTA_MULTIPLE_SOURCE_ROW_MATCHING_TARGET_ROW_IN_MERGE")
    engine.execute(f"MERGE INTO dim t USING {twice} s ON t.id = s.id WHEN NOT MATCHED THEN INSERT *")
    assert rows(engine.sql("SELECT id FROM dim")) == [(1,), (2,), (3,), (8,), (8,)]
    engine.execute(f"MERGE INTO dim t USING {twice} s ON t.id = s.id WHEN NOT MATCHED BY SOURCE THEN DELETE")
    assert rows(engine.sql("SELECT id FROM dim")) == [(2,), (8,), (8,)]
    _fails(engine, "MERGE INTO dim t USING (SELECT 1 AS id) s ON t.id = s.id WHEN MATCHED THEN UPDATE SET *", "UNRESOLVED_COLUMN.WITH_SUGGESTION")
    _fails(engine, "MERGE INTO dim t USING (SELECT CAST(NULL AS INT) AS id, 'x' AS name, 'y' AS tier) s ON t.id = s.id WHEN NOT MATCHED THEN INSERT *", "DELTA_NOT_NULL_CONSTRAINT_VIOLATED")


# --- comparison, recursion


def test_compare(spark):
    a = spark.createDataFrame([(1, 0.1 + 0.2), (1, 0.3), (2, None)], "a int, b double")
    b = spark.createDataFrame([(1, 0.3), (1, 0.3), (2, None)], "x long, y double")
    assert cmp.compare(a, b).equal and cmp.compare(a, b, ordered=True).equal
    assert not cmp.compare(a, b.orderBy("x", ascending=False), ordered=True).equal
    d = cmp.compare(a, b.limit(1))
    assert not d.equal and d.extra and "often" in d.reason
    assert "columns" in cmp.compare(a, b.select("x")).reason


def test_idempotent(engine):
    engine.execute("CREATE TABLE z AS SELECT 1 AS a")
    state = lambda: engine.sql("SELECT * FROM z")
    assert not cmp.idempotent(lambda: engine.execute("INSERT INTO z SELECT 2"), state).equal
    assert cmp.idempotent(lambda: engine.execute("MERGE INTO z t USING (SELECT 5 AS a) s ON t.a = s.a WHEN NOT MATCHED THEN INSERT *"), state).equal


def test_recursion_stops_or_raises(spark):
    with pytest.raises(DialectError) as e:
        fixpoint(spark.range(1), lambda d: d.selectExpr("id + 1 AS id"), max_steps=3)
    assert e.value.condition == "RECURSION_LEVEL_LIMIT_EXCEEDED"
    assert rows(fixpoint(spark.range(3), lambda d: d.selectExpr("max(id) - 1 AS id").where("id >= 0"))) == [(0,), (1,), (2,)]


def test_readers(spark, tmp_path):
    from tesseral.sources import readers

    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for fmt in ("parquet", "orc", "json", "csv"):
        readers.write(df, str(tmp_path / fmt), fmt)
        assert rows(readers.read(spark, str(tmp_path / fmt), fmt, "k int, v string")) == [(1, "a"), (2, None)]
    readers.write(df, str(tmp_path / "by"), partition_by=["k"])
    assert readers.read(spark, str(tmp_path / "by")).where("k = 2").count() == 1
    with pytest.raises(ValueError):
        readers.read(spark, str(tmp_path / "csv"), "csv")


def test_stream_upserts(spark, tmp_path):
    from pyspark.sql import functions as F

    from tesseral.sources.versioned import Store
    from tesseral.streaming.pipelines import upsert_batches

    store = Store(spark, str(tmp_path / "s"))
    store.write("t", spark.createDataFrame([(1, "old", 1)], "id int, v string, n int"))
    run = upsert_batches(spark, store, "t", ["id"], [F.desc("n")])
    batch = spark.createDataFrame([(1, "new", 5), (1, "mid", 3), (2, "x", 1)], "id int, v string, n int")
    run(batch, 0)
    run(batch, 0)
    assert rows(store.read("t")) == [(1, "new", 5), (2, "x", 1)]
