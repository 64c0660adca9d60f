"""Compliance and reporting queries, the metric contract, small queries and state transitions (inventory K, N, P)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.sqlapi import run
from ..registry import query
from ..sources.tables import AS_OF, dbl, ratio, total
from .finance import BASE, base
from .relational import LATEST_VAL, latest_valuation


def as_of():
    return F.lit(AS_OF).cast("date")


@query("k01_compliance_score", """WITH s AS (SELECT holding_id, count(*) AS n, count(*) FILTER (methodology = 'error') AS bad, count(*) FILTER (methodology = 'purchase') AS done FROM val GROUP BY 1)
  SELECT holding_id, round(0.3 * (100 - least(bad * 5, 100)) + 0.5 * 100 * done::DOUBLE / n::DOUBLE + 0.2 * CASE WHEN n > 50 THEN 100 ELSE 60 END, 2) AS score FROM s""")
def k01(t):
    s = t.val.groupBy("holding_id").agg(F.count("*").alias("n"), F.count_if(F.col("methodology") == "error").alias("bad"), F.count_if(F.col("methodology") == "purchase").alias("done"))
    score = F.lit(0.3) * (100 - F.least(F.col("bad") * 5, F.lit(100))) + F.lit(0.5) * 100 * dbl("done") / dbl("n") + F.lit(0.2) * F.when(F.col("n") > 50, 100).otherwise(60)
    return s.select("holding_id", F.round(score, 2).alias("score"))


@query("k02_escalation", f"""WITH o AS (SELECT inv_id, cost, date_diff('day', d, DATE '{AS_OF}') AS overdue FROM inv WHERE status = 'O'), l AS (SELECT *, CASE WHEN overdue > 1500 THEN 3 WHEN overdue > 700 THEN 2 ELSE 1 END AS top FROM o)
  SELECT inv_id, level::INT AS level FROM l, (SELECT unnest([1, 2, 3]) AS level) WHERE level <= top AND NOT (level = 1 AND cost < 50000)""")
def k02(t):
    """Levels up to that of the days overdue; small ones skip the first. The fan-out is three rows at most."""
    days = F.datediff(as_of(), "d")
    top = F.when(days > 1500, 3).when(days > 700, 2).otherwise(1)
    return t.inv.filter("status = 'O'").select("inv_id", "cost", F.explode(F.sequence(F.lit(1), top)).alias("level")).filter("not (level = 1 and cost < 50000)").select("inv_id", "level")


@query("k03_rag_heatmap", "SELECT fund, count(*) FILTER (cost > 400000) AS red, count(*) FILTER (cost > 200000 AND cost <= 400000) AS amber, count(*) FILTER (cost <= 200000) AS green FROM inv JOIN company USING (company_id) GROUP BY 1")
def k03(t):
    c = F.col("cost")
    parts = {"red": c > 400000, "amber": (c > 200000) & (c <= 400000), "green": c <= 200000}
    per = t.inv.groupBy("company_id").agg(*[F.count_if(v).alias(k) for k, v in parts.items()]).join(t.company, "company_id")
    return per.groupBy("fund").agg(*[F.sum(k).alias(k) for k in parts])


@query("k04_stake_severity", "SELECT p_partkey AS part_id, CASE WHEN p_size > 25 THEN 'urgent' WHEN p_size > 10 THEN 'high' ELSE 'normal' END AS severity FROM part")
def k04(t):
    return t.part.select(F.col("p_partkey").alias("part_id"), F.when(F.col("p_size") > 25, "urgent").when(F.col("p_size") > 10, "high").otherwise("normal").alias("severity"))


@query("k05_calendar", "SELECT r_name AS fund, report, due FROM region, (SELECT 'quarterly' AS report, (q + INTERVAL 14 DAY)::DATE AS due FROM (SELECT unnest(generate_series(DATE '2001-04-01', DATE '2002-01-01', INTERVAL 3 MONTH)) q) UNION ALL SELECT 'annual', DATE '2001-06-30')")
def k05(t):
    """Four quarterly reports, each due two weeks after its quarter, and one a year, for each fund."""
    quarters = F.transform(F.sequence(F.lit("2001-04-01").cast("date"), F.lit("2002-01-01").cast("date"), F.expr("interval 3 months")), lambda q: F.struct(F.lit("quarterly").alias("report"), F.date_add(q, 14).alias("due")))
    both = F.concat(quarters, F.array(F.struct(F.lit("annual").alias("report"), F.lit("2001-06-30").cast("date").alias("due"))))
    return t.region.select(F.col("r_name").alias("fund"), F.explode(both).alias("x")).select("fund", "x.*")


@query("k06_status_transition", "SELECT inv_id, CASE WHEN d < DATE '2001-07-01' THEN 'overdue' WHEN d <= DATE '2001-07-06' THEN 'due' ELSE 'upcoming' END AS state FROM inv")
def k06(t):
    today = F.lit("2001-07-01").cast("date")
    return t.inv.select("inv_id", F.when(F.col("d") < today, "overdue").when(F.col("d") <= F.date_add(today, 5), "due").otherwise("upcoming").alias("state"))


@query("k07_reminders_once", "SELECT inv_id FROM inv WHERE (d + 3 = DATE '2000-03-10' OR d + 5 = DATE '2000-03-10') AND NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = inv_id AND toxic = 1)")
def k07(t):
    sent = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("inv_id"))
    today = F.lit("2000-03-10").cast("date")
    return t.inv.filter((F.date_add("d", 3) == today) | (F.date_add("d", 5) == today)).join(sent, "inv_id", "left_anti").select("inv_id")


@query("k08_report_frame", "SELECT c.company, c.sector, i.stage, i.d AS invested, i.cost::DOUBLE AS cost, coalesce(r.net, 0)::DOUBLE AS received FROM inv i JOIN company c USING (company_id) LEFT JOIN (SELECT inv_id, sum(net) AS net FROM recv GROUP BY 1) r USING (inv_id)")
def k08(t):
    net = t.recv.groupBy("inv_id").agg(F.sum("net").alias("net"))
    rows = t.inv.join(net, "inv_id", "left").join(t.company, "company_id")
    return rows.select("company", "sector", "stage", F.col("d").alias("invested"), dbl("cost").alias("cost"), F.coalesce(dbl("net"), F.lit(0.0)).alias("received"))


@query("k12_board_pack", "SELECT company_id, string_agg(inv_id || ':' || stage, ';' ORDER BY inv_id) AS pack FROM inv GROUP BY 1")
def k12(t):
    doc = F.array_sort(F.collect_list(F.struct("inv_id", "stage")))  # a company's own investments
    return t.inv.groupBy("company_id").agg(doc.alias("p")).select("company_id", F.array_join(F.transform("p", lambda x: F.concat(x["inv_id"].cast("string"), F.lit(":"), x["stage"])), ";").alias("pack"))


@query("k13_portfolio_heatmap", f"WITH {LATEST_VAL} SELECT company_id, coalesce(fv, 0)::DOUBLE AS fv, coalesce(quality * 90, 50)::INT AS risk, CASE WHEN quality IS NULL THEN 'medium' WHEN quality = 1 THEN 'low' ELSE 'high' END AS tier FROM company LEFT JOIN lv ON holding_id = company_id LEFT JOIN labels ON doc_id = company_id")
def k13(t):
    lv = latest_valuation(t).select(F.col("holding_id").alias("company_id"), "fv")
    marks = t.labels.select(F.col("doc_id").alias("company_id"), "quality")
    rows = t.company.select("company_id").join(lv, "company_id", "left").join(marks, "company_id", "left")
    return rows.select("company_id", F.coalesce(dbl("fv"), F.lit(0.0)).alias("fv"), F.coalesce(F.col("quality") * 90, F.lit(50)).cast("int").alias("risk"), F.when(F.col("quality").isNull(), "medium").when(F.col("quality") == 1, "low").otherwise("high").alias("tier"))


@query("k14_parameterised_sql", "SELECT fund, count(*) AS companies FROM company WHERE segment = 'BUILDING' GROUP BY 1")
def k14(t):
    return run(t, "SELECT fund, count(*) AS companies FROM company WHERE segment = :segment GROUP BY fund", {"segment": "BUILDING"})


TEMPLATES = {
    "k14_fund_info": ("SELECT fund, sector, count(*) AS companies FROM company WHERE fund = :fund GROUP BY fund, sector", {"fund": "ASIA"}, "SELECT fund, sector, count(*) AS companies FROM company WHERE fund = 'ASIA' GROUP BY 1, 2"),
    "k14_deal_pipeline": ("SELECT stage, count(*) AS deals, max(d) AS newest FROM inv WHERE status = :status AND cost >= :least GROUP BY stage", {"status": "P", "least": 100000}, "SELECT stage, count(*) AS deals, max(d) AS newest FROM inv WHERE status = 'P' AND cost >= 100000 GROUP BY 1"),
    "k14_import_data": ("SELECT methodology, count(*) AS n, max(d) AS newest FROM val WHERE methodology <> :kind GROUP BY methodology", {"kind": "view"}, "SELECT methodology, count(*) AS n, max(d) AS newest FROM val WHERE methodology <> 'view' GROUP BY 1"),
}


def template(name: str, sql: str, args: dict, oracle: str) -> None:
    """A statement with named parameters that are bound, never spliced in."""
    query(name, oracle)(lambda t: run(t, sql, args))


for _name, _parts in TEMPLATES.items():
    template(_name, *_parts)


@query("k16_aggregate_and_detail", "SELECT inv_id, cost::DOUBLE AS cost, (SELECT count(*) FROM inv) AS all_rows, round(100 * cost::DOUBLE / (SELECT sum(cost)::DOUBLE FROM inv), 8) AS share FROM inv WHERE cost > 490000")
def k16(t):
    """Filtered detail beside figures over all rows."""
    whole = t.inv.agg(F.count("*").alias("all_rows"), F.sum("cost").cast("double").alias("s"))
    return t.inv.filter("cost > 490000").crossJoin(whole).select("inv_id", dbl("cost").alias("cost"), "all_rows", F.round(100 * dbl("cost") / F.col("s"), 8).alias("share"))  # one row


@query("n01_05_fund_metrics", f"""WITH {BASE} SELECT fund, (active_fv - called)::DOUBLE AS unrealised_gain, (committed - called)::DOUBLE AS available, round(called::DOUBLE / committed::DOUBLE * 100, 4) AS drawdown_pct, round(committed::DOUBLE * 0.02 * 3, 2) AS fees_three_years FROM fb""")
def n01(t):
    b = base(t)
    return b.select("fund", dbl(F.col("active_fv") - F.col("called")).alias("unrealised_gain"), dbl(F.col("committed") - F.col("called")).alias("available"), F.round(dbl("called") / dbl("committed") * 100, 4).alias("drawdown_pct"), F.round(dbl("committed") * 0.02 * 3, 2).alias("fees_three_years"))


@query("n02_realised_gains", "SELECT sum(r.net - i.cost)::DOUBLE AS realised_gain FROM inv i JOIN (SELECT inv_id, sum(net) AS net FROM recv GROUP BY 1) r USING (inv_id) WHERE i.status = 'F'")
def n02(t):
    net = t.recv.groupBy("inv_id").agg(F.sum("net").alias("net"))
    return t.inv.filter("status = 'F'").join(net, "inv_id").agg(F.sum(F.col("net") - F.col("cost")).cast("double").alias("realised_gain"))


@query("n06_company_counts", f"SELECT count(DISTINCT company_id) AS companies, round(sum(cost)::DOUBLE / count(DISTINCT company_id)::DOUBLE, 4) AS cost_per_company FROM inv")
def n06(t):
    per = t.inv.groupBy("company_id").agg(F.sum("cost").alias("c"))
    return per.agg(F.count("*").alias("companies"), ratio(F.sum("c"), F.count("*")).alias("cost_per_company"))


@query("n09_portfolio_mrr", f"WITH {LATEST_VAL} SELECT sum(fv)::DOUBLE AS mrr, (sum(fv) * 12)::DOUBLE AS arr, round(sum(fair)::DOUBLE / count(fair)::DOUBLE, 4) AS mean_churn FROM lv")
def n09(t):
    return latest_valuation(t).agg(F.sum("fv").cast("double").alias("mrr"), (F.sum("fv") * 12).cast("double").alias("arr"), ratio(F.sum("fair"), F.count("fair")).alias("mean_churn"))


@query("n14_per_sector", "SELECT sector, count(*) AS n, sum(cost)::DOUBLE AS cost, round(sum(cost)::DOUBLE / sum(sum(cost)) OVER ()::DOUBLE * 100, 4) AS pct FROM inv JOIN company USING (company_id) GROUP BY 1")
def n14(t):
    g = t.inv.groupBy("company_id").agg(F.count("*").alias("n"), F.sum("cost").alias("c")).join(t.company, "company_id").groupBy("sector").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    return g.crossJoin(g.agg(F.sum("c").alias("whole"))).select("sector", "n", dbl("c").alias("cost"), F.round(dbl("c") / dbl("whole") * 100, 4).alias("pct"))  # one row


@query("n15_per_stage", "SELECT stage, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER ()::DOUBLE * 100, 4) AS pct, sum(cost)::DOUBLE AS cost FROM inv GROUP BY 1")
def n15(t):
    g = t.inv.groupBy("stage").agg(F.count("*").alias("n"), total("cost", "cost"))
    return g.crossJoin(g.agg(F.sum("n").alias("whole"))).select("stage", "n", F.round(dbl("n") / dbl("whole") * 100, 4).alias("pct"), "cost")  # one row


@query("n16_per_geography", "SELECT fund AS geography, count(*) AS n, sum(cash)::DOUBLE AS fv FROM company GROUP BY 1")
def n16(t):
    return t.company.groupBy(F.col("fund").alias("geography")).agg(F.count("*").alias("n"), total("cash", "fv"))


@query("n17_per_exit_type", "SELECT flag AS exit_type, count(*) AS n, sum(net)::DOUBLE AS proceeds, round(sum(net)::DOUBLE / sum(gross)::DOUBLE, 4) AS moic FROM recv GROUP BY 1")
def n17(t):
    g = t.recv.groupBy(F.col("flag").alias("exit_type")).agg(F.count("*").alias("n"), F.sum("net").alias("p"), F.sum("gross").alias("g"))
    return g.select("exit_type", "n", dbl("p").alias("proceeds"), ratio("p", "g").alias("moic"))


@query("n18_total_fair_value", f"WITH {BASE} SELECT fund, CASE WHEN active_fv IS NULL AND realised IS NULL THEN NULL ELSE coalesce(active_fv, 0) + coalesce(realised, 0) END::DOUBLE AS fair_value FROM fb")
def n18(t):
    both = F.when(F.col("active_fv").isNotNull() | F.col("realised").isNotNull(), F.coalesce("active_fv", F.lit(0)) + F.coalesce("realised", F.lit(0)))
    return base(t).select("fund", dbl(both).alias("fair_value"))


@query("n21_last_twelve_periods", "SELECT y, m, sum(cost)::DOUBLE AS cost FROM (SELECT year(d)::INT AS y, month(d)::INT AS m, cost FROM inv) GROUP BY 1, 2 ORDER BY y DESC, m DESC LIMIT 12")
def n21(t):
    """By number, not by label: month 10 comes after 2."""
    return t.inv.groupBy(F.year("d").alias("y"), F.month("d").alias("m")).agg(total("cost", "cost")).orderBy(F.desc("y"), F.desc("m")).limit(12)


@query("p01_ytd_same_months", "WITH m AS (SELECT DISTINCT month(d) AS m FROM inv WHERE year(d) = 2001) SELECT year(d)::INT AS y, sum(cost)::DOUBLE AS ytd FROM inv WHERE month(d) IN (SELECT m FROM m) GROUP BY 1")
def p01(t):
    months = t.inv.filter(F.year("d") == 2001).select(F.month("d").alias("m")).distinct()
    return t.inv.withColumn("m", F.month("d")).join(months, "m", "left_semi").groupBy(F.year("d").alias("y")).agg(total("cost", "ytd"))


@query("p03_ledger_buckets", "SELECT strftime(d, '%Y-%m') AS period, coalesce(sum(gross) FILTER (flag = 'R'), 0)::DOUBLE AS revenue, coalesce(sum(gross) FILTER (flag = 'A'), 0)::DOUBLE AS cogs, (coalesce(sum(gross) FILTER (flag = 'R'), 0) - coalesce(sum(gross) FILTER (flag = 'A'), 0))::DOUBLE AS gp FROM recv GROUP BY 1")
def p03(t):
    g = t.recv.groupBy(F.date_format("d", "yyyy-MM").alias("period")).pivot("flag", ["R", "A"]).agg(F.sum("gross"))
    r, a = (F.coalesce(F.col(k), F.lit(0).cast("decimal(18,2)")) for k in "RA")
    return g.select("period", dbl(r).alias("revenue"), dbl(a).alias("cogs"), dbl(r - a).alias("gp"))


@query("p06_newest_import", "SELECT arg_max(page_id, page_id) AS page_id, coalesce(nullif(regexp_extract(url, '://([^/?#]+)', 1), ''), url) AS key FROM pages GROUP BY 2")
def p06(t):
    key = F.coalesce(F.nullif(F.regexp_extract("url", "://([^/?#]+)", 1), F.lit("")), F.col("url"))
    return t.pages.groupBy(key.alias("key")).agg(F.max("page_id").alias("page_id"))


@query("p10_moic_buckets", "WITH m AS (SELECT i.company_id, sum(r.net)::DOUBLE / nullif(sum(i.cost), 0)::DOUBLE AS moic FROM inv i LEFT JOIN (SELECT inv_id, sum(net) AS net FROM recv GROUP BY 1) r USING (inv_id) GROUP BY 1) SELECT CASE WHEN moic >= 2 THEN '>=2' WHEN moic >= 1 THEN '1-2' WHEN moic >= 0.5 THEN '0.5-1' ELSE '<0.5' END AS bucket, count(*) AS n FROM m WHERE moic IS NOT NULL GROUP BY 1")
def p10(t):
    net = t.recv.groupBy("inv_id").agg(F.sum("net").alias("net"))
    m = t.inv.join(net, "inv_id", "left").groupBy("company_id").agg(F.try_divide(F.sum("net").cast("double"), F.nullif(F.sum("cost").cast("double"), F.lit(0.0))).alias("moic")).filter("moic is not null")
    return m.groupBy(F.when(F.col("moic") >= 2, ">=2").when(F.col("moic") >= 1, "1-2").when(F.col("moic") >= 0.5, "0.5-1").otherwise("<0.5").alias("bucket")).agg(F.count("*").alias("n"))


@query("p11_top_companies", f"WITH {LATEST_VAL} SELECT company_id, fv::DOUBLE AS fv FROM company JOIN lv ON holding_id = company_id ORDER BY fv DESC, company_id LIMIT 10")
def p11(t):
    lv = latest_valuation(t).select(F.col("holding_id").alias("company_id"), "fv")
    return t.company.join(lv, "company_id").orderBy(F.desc("fv"), "company_id").limit(10).select("company_id", dbl("fv").alias("fv"))


@query("p12_sector_allocation", f"WITH {LATEST_VAL}, a AS (SELECT sector, sum(cost) AS cost FROM inv JOIN company USING (company_id) GROUP BY 1), b AS (SELECT sector, sum(fv) AS fv FROM lv JOIN company ON company_id = holding_id GROUP BY 1) SELECT coalesce(a.sector, b.sector) AS sector, coalesce(cost, 0)::DOUBLE AS cost, coalesce(fv, 0)::DOUBLE AS fv FROM a FULL JOIN b ON a.sector = b.sector")
def p12(t):
    sector = t.company.select("company_id", "sector")
    a = t.inv.groupBy("company_id").agg(F.sum("cost").alias("c")).join(sector, "company_id").groupBy("sector").agg(F.sum("c").alias("cost"))
    b = latest_valuation(t).withColumnRenamed("holding_id", "company_id").join(sector, "company_id").groupBy("sector").agg(F.sum("fv").alias("fv"))
    return a.join(b, "sector", "full").select("sector", *[F.coalesce(dbl(c), F.lit(0.0)).alias(c) for c in ("cost", "fv")])


@query("p13_fund_burn", f"WITH {BASE} SELECT fund, (distributed - called)::DOUBLE AS net_burn, CASE WHEN distributed > called THEN floor(cash::DOUBLE / (distributed - called)::DOUBLE)::BIGINT END AS runway FROM fb JOIN cv USING (fund)")
def p13(t):
    from .finance import marks

    b = base(t).join(marks(t), "fund")
    gap = F.col("distributed") - F.col("called")
    return b.select("fund", dbl(gap).alias("net_burn"), F.when(gap > 0, F.floor(dbl("cash") / dbl(gap)).cast("long")).alias("runway"))


@query("p14_approved_else_any", "SELECT holding_id, arg_max(val_id, ((methodology = 'purchase')::INT, ts, val_id)) AS val_id FROM val GROUP BY 1")
def p14(t):
    return t.val.groupBy("holding_id").agg(F.max_by("val_id", F.struct((F.col("methodology") == "purchase").cast("int"), "ts", "val_id")).alias("val_id"))


@query("p18_pending_counts", "SELECT company_id, count(*) FILTER (status = 'O') AS pending FROM inv GROUP BY 1")
def p18(t):
    return t.inv.groupBy("company_id").agg(F.count_if(F.col("status") == "O").alias("pending"))


@query("p19_seed_upsert", "SELECT CASE WHEN l.doc_id IS NULL THEN 'created' ELSE 'updated' END AS outcome, count(*) AS n FROM (SELECT DISTINCT company_id FROM inv) i LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = i.company_id GROUP BY 1")
def p19(t):
    from ..sources.upsert import upserted

    old = t.labels.select(F.col("doc_id").alias("company_id"), F.lit("old").alias("state"))
    new = t.inv.select("company_id").distinct().withColumn("state", F.lit("new"))
    merged = upserted(old, new, ["company_id"])
    return merged.filter("outcome <> 'kept'").groupBy("outcome").agg(F.count("*").alias("n"))


@query("p20_all_paid", "SELECT inv_id, bool_and(line = 'F') AS paid FROM recv GROUP BY 1")
def p20(t):
    return t.recv.groupBy("inv_id").agg(F.bool_and(F.col("line") == "F").alias("paid"))


@query("p09_orphans", "SELECT p_partkey AS part_id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity = 50)")
def p09(t):
    """What nothing refers to any more once only the largest exits are left."""
    return t.part.select(F.col("p_partkey").alias("part_id")).join(t.recv.filter("flag = 'R' and qty = 50").select("part_id"), "part_id", "left_anti")


@query("k11_risk_with_trend", """WITH r AS (SELECT holding_id, fair, ts, val_id, lag(fair) OVER (PARTITION BY holding_id ORDER BY ts, val_id) AS p, row_number() OVER (PARTITION BY holding_id ORDER BY ts DESC, val_id DESC) rn FROM val) SELECT holding_id, fair::DOUBLE AS score, CASE WHEN p IS NULL THEN 'stable' WHEN fair > p + 1 THEN 'up' WHEN fair < p - 1 THEN 'down' ELSE 'stable' END AS trend FROM r WHERE rn = 1""")
def k11(t):
    two = Window.partitionBy("holding_id").orderBy(F.desc("ts"), F.desc("val_id"))
    r = t.val.withColumn("rn", F.row_number().over(two)).withColumn("p", F.lead("fair").over(two)).filter("rn = 1")
    return r.select("holding_id", dbl("fair").alias("score"), F.when(F.col("fair") > F.col("p") + 1, "up").when(F.col("fair") < F.col("p") - 1, "down").otherwise("stable").alias("trend"))
