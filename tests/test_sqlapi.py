"""The guard over Catalyst's tree."""

import pytest

from fundloom.plans import sqlapi
from fundloom.sources.tables import Tables

REFLECT = "reflect('java.lang.System', 'getProperty', 'user.home')"
WIDE = ", ".join(f"inv_id + {i} AS c{i}" for i in range(200))
DEEP = f"SELECT {REFLECT} AS x FROM inv"
for _ in range(6):
    DEEP = f"SELECT * FROM inv WHERE cost IN (SELECT max(cost) FROM inv WHERE EXISTS ({DEEP}))"

BAD = (
    f"SELECT {WIDE}, {REFLECT} AS r FROM inv", f"SELECT {', '.join(['inv_id'] * 40)}, {REFLECT} FROM inv", DEEP, f"SELECT transform(array(1, 2), x -> {REFLECT}) FROM inv", f"SELECT aggregate(array(1), 0, (a, x) -> a + length({REFLECT})) FROM inv",
    f"SELECT count(*) FILTER (WHERE {REFLECT} = 'x') FROM inv", f"SELECT sum(cost) OVER (PARTITION BY {REFLECT}) FROM inv", f"SELECT sum(cost) OVER w FROM inv WINDOW w AS (ORDER BY {REFLECT})", f"SELECT 1 FROM inv GROUP BY CUBE ({REFLECT})", f"SELECT 1 FROM inv ORDER BY {REFLECT}",
    f"SELECT 1 FROM inv HAVING max({REFLECT}) = 'x'", f"SELECT * FROM inv a JOIN inv b ON a.inv_id = length({REFLECT})", f"SELECT * FROM (VALUES ({REFLECT})) v(x)", f"WITH a AS (WITH b AS (SELECT {REFLECT} AS x) SELECT * FROM b) SELECT * FROM a", f"SELECT * FROM inv |> WHERE {REFLECT} = 'x'",
    f"SELECT * FROM inv LATERAL VIEW explode(array({REFLECT})) e AS x", f"SELECT * FROM inv, LATERAL (SELECT {REFLECT})", "SELECT TRANSFORM (inv_id) USING 'cat' AS (x) FROM inv", "SELECT * FROM range(3)", "SELECT system.builtin.reflect('a', 'b') FROM inv", "SELECT `reflect`('a', 'b') FROM inv",
    "SELECT (SELECT max(id) FROM hidden) AS m FROM inv", "SELECT * FROM inv WHERE EXISTS (SELECT 1 FROM hidden)", "SELECT * FROM inv WHERE inv_id IN (SELECT id FROM (SELECT * FROM hidden))", "SELECT shady(inv_id) FROM inv", "SELECT trim(shady(inv_id)) FROM inv", "SELECT CASE WHEN shady(1) THEN 1 END FROM inv",
    "SELECT abs(inv_id) FROM inv; DROP TABLE inv", "EXPLAIN SELECT 1", "CACHE TABLE inv",
)
GOOD = (
    f"SELECT {WIDE} FROM inv", "SELECT transform(array(1, -2), x -> abs(x)) AS t FROM inv LIMIT 1", "SELECT sum(cost) OVER (PARTITION BY company_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM inv", "SELECT status, count(*) FILTER (WHERE cost > 10) AS n FROM inv GROUP BY ROLLUP (status) HAVING count(*) > 0 ORDER BY 1",
    "SELECT * FROM inv WHERE company_id IN (SELECT company_id FROM company WHERE cash BETWEEN 0 AND 9) OR EXISTS (SELECT 1 FROM val WHERE fair > (SELECT avg(fair) FROM val))", "SELECT x.a FROM (VALUES (1), (2)) x(a)", "SELECT CASE WHEN status LIKE 'O%' THEN 'open' ELSE status || '!' END AS s, CAST(cost AS INT) AS c FROM inv UNION ALL SELECT 'reflect(x)', 1",
    "WITH a AS (SELECT company_id AS k, max(d) AS d FROM inv GROUP BY company_id) SELECT c.company FROM a JOIN company c ON a.k = c.company_id ORDER BY c.company LIMIT 3 OFFSET 1",
)


@pytest.fixture(scope="module")
def views(spark, sf):
    spark.range(3).createOrReplaceTempView("hidden")
    spark.udf.register("shady", lambda x: x, "long")
    return Tables(spark, sf)


@pytest.mark.parametrize("i", range(len(BAD)))
def test_refused(views, i):
    with pytest.raises(Exception) as told:
        sqlapi.run(views, BAD[i])
    assert isinstance(told.value, sqlapi.Refused) or "PARSE_SYNTAX_ERROR" in str(told.value), told.value


@pytest.mark.parametrize("i", range(len(GOOD)))
def test_allowed(views, i):
    assert sqlapi.run(views, GOOD[i]).count() >= 0


def test_functions_of_the_session_do_not_pass_for_known_ones(spark, sf):
    own = spark.newSession()
    own.udf.register("abs", lambda x: x, "long")
    with pytest.raises(sqlapi.Refused, match="foreign code"):
        sqlapi.run(Tables(own, sf), "SELECT abs(inv_id) AS x FROM inv WHERE inv_id IN (SELECT abs(inv_id) FROM inv)")
