"""Guarded SQL: what is refused, what is allowed, and that each of the two looks holds by itself."""

from __future__ import annotations

import pytest

from trisettle.operators import guard


@pytest.fixture(scope="module")
def views(spark):
    rows = [(i, i % 3, f"name {i}", f"2024-01-{i % 28 + 1:02d} 10:30:00", "a" if i < 800 else "b") for i in range(1000)]
    frame = spark.createDataFrame(rows, "n int, k int, name string, at string, tenant_id string").selectExpr("n", "k", "name", "cast(at as timestamp) as at", "tenant_id")
    return guard.scoped({"guarded": frame, "second": frame}, "a")


REFUSED = [
    "DELETE FROM guarded", "UPDATE guarded SET n = 1", "INSERT INTO guarded VALUES (1)", "DROP TABLE guarded", "TRUNCATE TABLE guarded", "ALTER TABLE guarded ADD COLUMN x INT", "CREATE TABLE t (x INT)",
    "CREATE TABLE t AS SELECT 1", "GRANT ALL ON guarded TO PUBLIC", "CACHE TABLE guarded", "SET spark.x = 1", "ADD JAR '/tmp/x.jar'", "EXPLAIN SELECT n FROM guarded", "DESCRIBE guarded", "SHOW TABLES",
    "WITH gone AS (DELETE FROM guarded) SELECT * FROM gone", "SELECT 1; SELECT 2", "SELECT n FROM guarded; DROP TABLE guarded", "nonsense", "SELECT FROM WHERE ORDER wat", "SELECT 1",
    "SELECT * FROM other", "SELECT n FROM guarded WHERE n IN (SELECT n FROM other)", "SELECT 'other AS (' AS x, s.* FROM other s", "SELECT * FROM parquet.`/tmp`", "SELECT * FROM information_schema.tables",
    "WITH other AS (SELECT 1 AS n) SELECT * FROM guarded WHERE n IN (WITH z AS (SELECT 1) SELECT * FROM secret)", "SELECT * FROM (WITH other AS (SELECT 1 AS n) SELECT n FROM other) x JOIN other y ON x.n = y.n",
    "SELECT reflect('java.lang.System', 'getenv', 'PATH') FROM guarded", "SELECT java_method('java.lang.System', 'lineSeparator') FROM guarded", "SELECT n FROM guarded ORDER BY reflect('a', 'b')",
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.name') FROM guarded", "SELECT IDENTIFIER('n') FROM guarded", "SELECT n FROM IDENTIFIER('guarded')",
    "SELECT IDENTIFIER(reflect('java.lang.System', 'getProperty', 'user.name')) FROM guarded", "SELECT n FROM guarded, VALUES (reflect('java.lang.System', 'getProperty', 'user.name')) v(x)",
    "SELECT current_user FROM guarded", "SELECT current_user() FROM guarded", "SELECT user FROM guarded", "SELECT session_user FROM guarded", "SELECT current_catalog() FROM guarded", "SELECT version() FROM guarded",
    "SELECT current_timestamp FROM guarded", "SELECT rand() FROM guarded", "SELECT input_file_name() FROM guarded", "SELECT system.builtin.reflect('a', 'b') FROM guarded", "SELECT `reflect`('a', 'b') FROM guarded",
    "SELECT n FROM guarded TABLESAMPLE (10 PERCENT)", "SELECT * FROM guarded, LATERAL (SELECT reflect('a', 'b'))", "SELECT * FROM guarded LATERAL VIEW explode(array(1)) t AS x",
    "SELECT * FROM guarded, LATERAL explode(array(1))", "SELECT * FROM range(10)", "SELECT * FROM guarded, range(1000000)", "SELECT explode(array(1, 2)) FROM guarded", "SELECT * FROM guarded PIVOT (max(n) FOR k IN (1, 2))",
    "SELECT TRANSFORM (n) USING 'cat' AS (n) FROM guarded", "SELECT n FROM guarded WHERE tenant_id = 'b'", "SELECT n FROM guarded WHERE missing = 1", "FROM guarded |> SELECT reflect('a', 'b')",
    "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r) SELECT r.n FROM r, guarded", "SELECT n FROM guarded WHERE EXISTS (SELECT reflect('a', 'b') FROM second)",
    "SELECT sum(n) FILTER (WHERE reflect('a', 'b') = 'x') FROM guarded", "SELECT filter(array(1), x -> reflect('a', 'b') = 'x') FROM guarded", "SELECT n FROM guarded GROUP BY n HAVING reflect('a', 'b') = 'x'",
    "SELECT sum(n) OVER (PARTITION BY reflect('a', 'b')) FROM guarded", "SELECT n FROM guarded LIMIT length(reflect('a', 'b'))", "SELECT from_json('{}', 'x INT') FROM guarded", "SELECT sequence(1, 100000000) FROM guarded",
    "SELECT repeat('x', 1000000000) FROM guarded", "SELECT n FROM guarded VERSION AS OF 1", "SELECT :x FROM guarded", "SELECT ? FROM guarded",
]


@pytest.mark.parametrize("text", REFUSED)
def test_refused(spark, views, text):
    with pytest.raises(guard.Refused):
        guard.run(spark, text, views).collect()


ALLOWED = {
    "```sql\nSELECT n FROM guarded WHERE n > 10 ORDER BY n;\n```": 500, "SELECT n FROM guarded LIMIT 5": 5, "SELECT n FROM guarded TABLESAMPLE (5 ROWS)": 5, "SELECT n FROM guarded LIMIT 100000": 500, "SELECT n FROM guarded WHERE n BETWEEN 10 AND 19": 10,
    "SELECT n FROM guarded WHERE n NOT BETWEEN 5 AND 799": 5, "SELECT sqrt(n), hour(at), year(at), date_trunc('month', at) FROM guarded WHERE n < 3": 3, "SELECT DISTINCT k FROM guarded": 3,
    "SELECT k, sum(n) AS s, count(*) FROM guarded GROUP BY k HAVING sum(n) > 0 ORDER BY s DESC": 3, "SELECT n FROM (SELECT n, row_number() OVER (PARTITION BY k ORDER BY n) AS r FROM guarded) t WHERE r = 1": 3,
    "WITH w AS (SELECT max(n) AS m FROM guarded) SELECT m FROM w": 1, "SELECT count(*) FROM guarded WHERE n = (SELECT max(n) FROM second)": 1, "SELECT a.n FROM guarded a JOIN second b ON a.n = b.n WHERE a.n < 4": 4,
    "SELECT a.n FROM guarded a, second b WHERE a.n = b.n AND a.n IN (1, 2)": 2, "SELECT n FROM guarded WHERE EXISTS (SELECT 1 FROM second s WHERE s.n = guarded.n AND s.n < 2)": 2,
    "SELECT CASE WHEN n > 1 THEN 'x' ELSE upper(name) END || '!' FROM guarded WHERE name LIKE 'name 1%' AND n < 2": 1, "SELECT n FROM guarded WHERE n < 1 UNION ALL SELECT n FROM second WHERE n < 1": 2,
    "SELECT n FROM guarded EXCEPT SELECT n FROM second": 0, "SELECT nvl(name, 'x'), coalesce(n, 0), CAST(n AS DOUBLE) / 2 FROM guarded WHERE n = 3": 1, "SELECT k, percentile(n, 0.5), stddev(n) FROM guarded GROUP BY ROLLUP (k)": 4,
    "SELECT exists(array(n), x -> x > 1) FROM guarded WHERE n = 2": 1, "SELECT date_add(to_date(at), 3), extract(day FROM at) FROM guarded WHERE n = 1": 1, "SELECT n FROM (SELECT n, k FROM guarded) t WHERE k = 0 AND n < 4": 2,
    "SELECT * FROM guarded, (VALUES (1), (2)) v(x) WHERE n = x": 2, "SELECT lpad(name, 9, 'x'), ceil(n / 2), ceil(n, 1), floor(n), contains(name, '1'), minute(at), second(at) FROM guarded WHERE n = 1": 1,
}


@pytest.mark.parametrize("text", ALLOWED)
def test_allowed(spark, views, text):
    assert guard.run(spark, text, views).count() == ALLOWED[text]


def test_one_tenant_only(spark, views):
    assert guard.run(spark, "SELECT max(n) AS m FROM guarded", views).first().m == 799
    with pytest.raises(guard.Refused):
        guard.scoped({"loose": spark.range(3)}, "a")


@pytest.mark.parametrize("text", ["SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.name') AS x FROM guarded", "SELECT current_user AS x FROM guarded", "SELECT * FROM range(3)", "SELECT n FROM guarded TABLESAMPLE (10 PERCENT)"])
def test_the_analysed_plan_alone_refuses(spark, views, text):
    views["guarded"].createOrReplaceTempView("guarded")
    with pytest.raises(guard.Refused):
        guard.analysed(spark, spark.sql(text), {"guarded"})
