"""What the third round of findings named: queries against their SQL on rows that once told them apart, and work that must not grow into one task."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from fundloom import catalog
from fundloom.functions import text
from fundloom.operators import reshape, routing
from fundloom.sources.snapshots import cascade
from fundloom.sources.tables import Tables, rounded

from .test_queries import TABLES, plain


def folder(tmp_path, sf, **changed):
    """A folder of tables: those of sf, but for the changed ones, each SQL over the old one or rows of it."""
    c = duckdb.connect()
    for name in TABLES:
        if name in changed:
            c.sql(f"create or replace view old as select * from '{sf}/{name}.parquet'")
            c.sql(f"copy ({changed[name]}) to '{tmp_path}/{name}.parquet' (format parquet)")
        else:
            os.symlink(f"{sf}/{name}.parquet", f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def same_as_sql(spark, at, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{at}/{t}.parquet'")
    df, want = catalog.QUERIES[name](spark, at), c.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    i = [want.columns.index(x) for x in columns]
    got = sorted(tuple(plain(r[x]) for x in columns) for r in df.collect())
    assert got == sorted(tuple(plain(r[k]) for k in i) for r in want.fetchall())
    return got


READINGS = [(40169, "2024-01-13 00:15:19.230948", "view", 34.64), (322517, "2024-01-07 18:14:31.087278", "view", 24.94), (1005283, "2024-01-02 14:25:38.137375", "view", 31.79), (2278988, "2024-01-24 16:48:38.132721", "purchase", 25.2), (3959804, "2024-01-18 22:22:38.970497", "purchase", 131.28), (4545014, "2024-01-14 10:27:50.67343", "purchase", 37.0), (4695073, "2024-01-29 12:34:55.644398", "purchase", 2.34), (4738322, "2024-01-12 11:29:42.796128", "view", 4.25), (5280871, "2024-01-25 06:07:57.673938", "view", 46.83), (5508943, "2024-01-03 16:43:07.852724", "signup", 8.85), (5690516, "2024-01-28 03:52:31.868816", "click", 59.88), (5970849, "2024-01-22 07:03:26.739063", "purchase", 23.91)]


@pytest.mark.parametrize("name", ["g52_ten_signals", "p23_risk_batch"])
def test_scores_at_a_half_round_as_sql(spark, sf, tmp_path, name):
    """F1, F4: a company whose weighed grades make 55.95, as a double a little less."""
    events = ", ".join(f"({i}, TIMESTAMP '{ts}', 4, '{kind}', {v}::DOUBLE, '{{\"k\": 1}}')" for i, ts, kind, v in READINGS)
    orders = "SELECT * REPLACE (CASE WHEN o_orderkey < 4 THEN 4 ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey < 4 THEN 'P' ELSE o_orderstatus END AS o_orderstatus) FROM old"
    at = folder(tmp_path, sf, events=f"SELECT * FROM (VALUES {events}) v(event_id, ts, user_id, event_type, value, props)", orders=orders)
    assert any("56" in r for r in same_as_sql(spark, at, name))


def test_rounded_scales_first(spark):
    got = spark.createDataFrame([(55.949999999999996,), (30.05,), (-0.25,), (None,)], "x double").select(rounded(F.col("x"), 1)).collect()
    assert [r[0] for r in got] == [56.0, 30.1, -0.3, None]


def test_words_end_where_sql_says(spark, sf, tmp_path):
    """letters that aren't ASCII beside a word."""
    told = ["el lañdora", "Éla", "la", "plan", "the_x", "LA9", "x.the,", "İla", None, "là"]
    rows = ", ".join(f"({i}, 0, 'user', {'NULL' if x is None else repr(x)})" for i, x in enumerate(told))
    at = folder(tmp_path, sf, conversations=f"SELECT i::BIGINT AS conv_id, k::BIGINT AS turn, role, text FROM (VALUES {rows}) v(i, k, role, text)")
    got = {int(r[0]): r[1] for r in same_as_sql(spark, at, "h26_keyword_in_list")}
    assert got[0] == got[1] == got[2] == got[6] == "True" and got[3] == got[4] == got[5] == got[7] == got[9] == "False" and got[8] == "~"


def test_values_just_close_enough_agree(spark, sf, tmp_path):
    """decimals half a unit or a tenth apart, whose doubles differ by a little more."""
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-01', {i // 2}, '{('purchase', 'signup')[i % 2]}', {v}::DOUBLE, '{{\"k\": 1}}')" for i, v in enumerate((1.66, 1.16, 25.29, 28.1, 1.08, 0.58, 23.7, 21.33, 10.0, 11.2)))
    at = folder(tmp_path, sf, events=f"SELECT * FROM (VALUES {rows}) v(event_id, ts, user_id, event_type, value, props)")
    same_as_sql(spark, at, "j06_priority_pick")
    d = spark.createDataFrame([("1.66", "1.16")], "a string, b string").select(*[F.col(x).cast("decimal(18,2)").alias(x) for x in "ab"])
    assert d.select(text.close_to(F.col("a"), F.col("b"), 0.5, 0.1)).first()[0]


def test_rows_that_borrow_no_date_are_spread(spark):
    """rows that have no company to borrow from, and no row of few companies, meet in one task."""
    names = ["row_id", "domain", *routing.TEXTS, *routing.DATES, *routing.NUMBERS]
    kind = lambda n: "date" if n in routing.DATES else routing.MONEY if n in routing.NUMBERS else "string"
    rows = spark.range(0, 2000, 1, 4).select(F.col("id").alias("row_id"), F.when(F.col("id") % 2 == 0, "capital_calls").otherwise("portfolio_investments").alias("domain"), *[(F.lit("x") if n == "call_ref" else (F.col("id") % 2).cast("string") if n == "company_name" else F.lit(1) if n == "fair_value" else F.when(F.col("id") == 1, "2024-01-01") if n == "valuation_date" else F.lit(None)).cast(kind(n)).alias(n) for n in names[2:]])
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        df = routing.routed(rows)
        plan = df._jdf.queryExecution().executedPlan().toString()
        placed = Counter(r["p"] for r in df.withColumn("p", F.spark_partition_id()).collect())
    finally:
        for k in off:
            spark.conf.unset(k)
    assert sum(placed.values()) == 3000 and max(placed.values()) < 1000 and "BroadcastHashJoin" in plan


def test_orphans_are_sought_among_distinct_keys(spark):
    """F8: the keys that rows refer to are made distinct before they are joined."""
    make = lambda x, n: spark.createDataFrame(x, f"{n} long, k long")
    tables = {"payers": spark.createDataFrame([(1,), (2,), (3,), (4,)], "k long"), "rows": make([(1, 1), (2, 1), (3, 2), (4, 3), (5, 3), (6, None)], "id"), "more": make([(1, 2)], "m")}
    stay = cascade(tables, [("rows", "k", "payers", "k"), ("more", "k", "payers", "k")], {"rows": tables["rows"].filter("id in (1, 2, 3)").select("id")}, ["payers"])
    assert sorted(r["k"] for r in stay["payers"].collect()) == [2, 3, 4]
    assert stay["payers"]._jdf.queryExecution().analyzed().toString().count("Deduplicate") >= 5


def test_rows_of_a_sheet_are_numbered_without_one_task_a_sheet(spark, sf):
    """no window over a whole sheet; the few headers are broadcast, not met by key."""
    df = reshape.long_periods(Tables(spark, sf))
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() == 3 * spark.read.parquet(f"{sf}/customer.parquet").count()
