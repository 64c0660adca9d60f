"""Lists and states of investors, investments, imports and metrics (inventory G30, G31, G34, G60, N and P)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import flow, xirr
from ..registry import ORACLES, query
from ..sources.tables import AS_OF, MONEY, dbl, ratio
from ..sources.upsert import upserted
from .finance import COMPANY_RATES, FLOWS, company_rates, flows, irr_sql
from .fundframe import FRAME, frame, ladder
from .portfolio import KPI, MIS, g52, kpi, mis
from .relational import LATEST_VAL, latest_valuation

SNAPSHOTS = """snap AS (SELECT payer_id * 3 + part_id % 3 AS commitment, payer_id, s_nationkey AS scheme, arg_max({'a': gross * 2, 'b': gross, 'c': CASE WHEN flag = 'R' THEN net ELSE 0 END, 'd': qty * 1000, 'e': CASE WHEN n <> 1 THEN tax / gross * 100 END}, (d, inv_id, n)) AS x FROM recv JOIN supplier ON s_suppkey = payer_id GROUP BY 1, 2, 3),
lp AS (SELECT commitment, payer_id, scheme, x.a::DECIMAL(18,2) AS committed, x.b AS called, x.c::DECIMAL(18,4) AS distributed, x.d::DECIMAL(18,2) AS unrealized, x.e::DOUBLE AS irr FROM snap)"""
TOTALS = "round(sum(committed), 2)::DOUBLE AS committed, round(sum(called), 2)::DOUBLE AS called, round(sum(distributed), 2)::DOUBLE AS distributed, round(sum(unrealized), 2)::DOUBLE AS unrealized, round((sum(distributed) + sum(unrealized))::DOUBLE / nullif(sum(called), 0)::DOUBLE, 4) AS tvpi, round(sum(distributed)::DOUBLE / nullif(sum(called), 0)::DOUBLE, 4) AS dpi, round(sum(unrealized)::DOUBLE / nullif(sum(called), 0)::DOUBLE, 4) AS rvpi, round(sum(irr * called::DOUBLE) / nullif(sum(called), 0)::DOUBLE, 4) AS irr, count(*) AS commitments"


def snapshots(t) -> DataFrame:
    """The newest capital account of each commitment: of a payer's receipts, dealt out to three commitments by part."""
    r = t.recv.withColumn("commitment", F.col("payer_id") * 3 + F.col("part_id") % 3)
    account = F.struct((F.col("gross") * 2).cast(MONEY).alias("committed"), F.col("gross").alias("called"), F.when(F.col("flag") == "R", F.col("net")).otherwise(F.lit(0).cast("decimal(18,4)")).alias("distributed"), (F.col("qty") * 1000).cast(MONEY).alias("unrealized"), F.when(F.col("n") != 1, dbl("tax") / dbl("gross") * 100).alias("irr"))
    newest = r.groupBy("commitment", "payer_id").agg(F.max_by(account, F.struct("d", "inv_id", "n")).alias("x")).select("commitment", "payer_id", "x.*")
    return newest.join(t.supplier.select(F.col("s_suppkey").alias("payer_id"), F.col("s_nationkey").alias("scheme")), "payer_id")


def totals():
    """Ratios are of exact sums; the mean rate is weighed by what was called, in whole, also by accounts without a rate."""
    s, called = F.sum, F.sum("called")
    over = lambda x: ratio(x, called)
    return [*[dbl(F.round(s(c), 2)).alias(c) for c in ("committed", "called", "distributed", "unrealized")], over(s("distributed") + s("unrealized")).alias("tvpi"), over(s("distributed")).alias("dpi"), over(s("unrealized")).alias("rvpi"), over(s(F.col("irr") * dbl("called"))).alias("irr"), F.count("*").alias("commitments")]


@query("g30_lp_dashboard", f"WITH {SNAPSHOTS} SELECT scheme::BIGINT AS scheme, {TOTALS} FROM lp GROUP BY ROLLUP (scheme)")
def g30(t):
    """Per scheme, and over all of them in the row without a scheme."""
    return snapshots(t).withColumn("scheme", F.col("scheme").cast("long")).rollup("scheme").agg(*totals())


@query("n13_per_lp", f"WITH {SNAPSHOTS} SELECT payer_id, {TOTALS}, round(sum(called)::DOUBLE / nullif(sum(committed), 0)::DOUBLE * 100, 2) AS called_pct, round(sum(distributed) + sum(unrealized) - sum(called), 2)::DOUBLE AS position FROM lp GROUP BY 1")
def n13(t):
    return snapshots(t).groupBy("payer_id").agg(*totals(), F.round(F.try_divide(dbl(F.sum("called")), F.nullif(dbl(F.sum("committed")), F.lit(0.0))) * 100, 2).alias("called_pct"), dbl(F.round(F.sum("distributed") + F.sum("unrealized") - F.sum("called"), 2)).alias("position"))


@query("n12_per_investment", f"""WITH RECURSIVE {FLOWS}, {irr_sql('fl', 'inv_id')}, x AS (SELECT inv_id, sum(net)::DOUBLE AS got, sum(CASE WHEN flag = 'R' THEN net ELSE 0 END)::DOUBLE AS realised FROM recv GROUP BY 1)
  SELECT i.inv_id, i.cost::DOUBLE AS cost, CASE WHEN status = 'O' THEN cost::DOUBLE ELSE 0 END AS fv, round(coalesce(realised, 0), 2) AS realised, round(coalesce(realised, 0) + CASE WHEN status = 'O' THEN cost::DOUBLE ELSE 0 END - cost::DOUBLE, 2) AS gain, CASE WHEN irr BETWEEN -99.99 AND 999.99 THEN irr END AS irr,
  round((coalesce(got, 0) + CASE WHEN status = 'O' THEN cost::DOUBLE ELSE 0 END) / cost::DOUBLE, 4) AS moic, round(date_diff('day', i.d, DATE '{AS_OF}') / 365.25::DOUBLE, 2) AS holding_years, status FROM inv i LEFT JOIN x USING (inv_id) LEFT JOIN irr USING (inv_id)""")
def n12(t):
    """What is still held counts at cost."""
    x = t.recv.groupBy("inv_id").agg(dbl(F.sum("net")).alias("got"), dbl(F.sum(F.when(F.col("flag") == "R", F.col("net")).otherwise(0))).alias("realised"))
    rate = flows(t).groupBy("inv_id").agg(F.collect_list("f").alias("f")).select("inv_id", xirr(F.col("f")).alias("irr"))
    cost, zero = dbl("cost"), F.lit(0.0)
    fv, realised = F.when(F.col("status") == "O", cost).otherwise(0.0), F.coalesce("realised", zero)
    j = t.inv.join(x, "inv_id", "left").join(rate, "inv_id", "left")
    return j.select(
        "inv_id", cost.alias("cost"), fv.alias("fv"), F.round(realised, 2).alias("realised"), F.round(realised + fv - cost, 2).alias("gain"), F.when(F.col("irr").between(-99.99, 999.99), F.col("irr")).alias("irr"), F.round((F.coalesce("got", zero) + fv) / cost, 4).alias("moic"),
        F.round(F.datediff(F.lit(AS_OF).cast("date"), "d") / 365.25, 2).alias("holding_years"), "status",
    )


COMPANY = "x AS (SELECT inv_id, sum(net)::DOUBLE AS net FROM recv GROUP BY 1), g AS (SELECT company_id, sum(cost)::DOUBLE AS cost, sum(CASE WHEN status = 'F' THEN net END) AS proceeds, sum(net) / sum(cost::DOUBLE) AS moic, count(*) AS n FROM inv LEFT JOIN x USING (inv_id) GROUP BY 1)"


@query("g31_company_figures", f"""WITH RECURSIVE x AS (SELECT inv_id, sum(net) AS net FROM recv GROUP BY 1), cg AS (SELECT company_id, sum(cost) AS cost, sum(net) FILTER (status = 'F') AS proceeds, sum(net) AS net FROM inv LEFT JOIN x USING (inv_id) GROUP BY 1), {COMPANY_RATES}
  SELECT company_id, cost::DOUBLE AS cost, round(coalesce(nullif(proceeds, 0), net), 2)::DOUBLE AS fv, round(net::DOUBLE / nullif(cost, 0)::DOUBLE, 4) AS moic, CASE WHEN irr BETWEEN -99.99 AND 999.99 THEN irr END AS irr, CASE WHEN proceeds <> 0 THEN 'proceeds' WHEN net IS NOT NULL THEN 'multiple' ELSE 'unknown' END AS fv_from FROM cg LEFT JOIN irr USING (company_id)""")
def g31(t):
    """A company's value is what exits brought, else its multiple times its cost, that is its receipts; its rate is that of all its investments' flows."""
    c = F.col
    x = t.recv.groupBy("inv_id").agg(F.sum("net").alias("net"))
    g = t.inv.join(x, "inv_id", "left").groupBy("company_id").agg(F.sum("cost").alias("cost"), F.sum(F.when(c("status") == "F", c("net"))).alias("proceeds"), F.sum("net").alias("net"))
    g = g.join(company_rates(t), "company_id", "left")
    source = ladder([(c("proceeds") != 0, F.lit("proceeds")), (c("net").isNotNull(), F.lit("multiple"))], F.lit("unknown"))
    value = F.coalesce(F.when(c("proceeds") != 0, c("proceeds")), c("net"))
    return g.select("company_id", dbl("cost").alias("cost"), dbl(F.round(value, 2)).alias("fv"), ratio("net", "cost").alias("moic"), "irr", source.alias("fv_from"))


@query("g34_nav_fallback", """WITH r AS (SELECT val_id, CASE WHEN val_id % 3 = 0 THEN fair / 10 END AS npu, CASE WHEN val_id % 2 = 0 THEN holding END AS units, CASE WHEN val_id % 5 <> 0 THEN fair END AS assets, CASE WHEN val_id % 7 <> 0 THEN holding END AS cash, fair / 20 + CASE WHEN val_id % 5 = 0 THEN 90 ELSE 0 END AS fees FROM val)
  SELECT val_id, round(CASE WHEN npu > 0 AND units > 0 THEN npu * units WHEN coalesce(assets, 0) + coalesce(cash, 0) - fees > 0 THEN coalesce(assets, 0) + coalesce(cash, 0) - fees END, 4)::DOUBLE AS nav, CASE WHEN npu > 0 AND units > 0 THEN 'units' WHEN coalesce(assets, 0) + coalesce(cash, 0) - fees > 0 THEN 'assets' ELSE 'none' END AS rung FROM r""")
def g34(t):
    """Value a unit times units where both are positive; else assets less liabilities if positive; else none."""
    k, zero = F.col("val_id"), F.lit(0.0)
    r = t.val.select("val_id", F.when(k % 3 == 0, dbl("fair") / 10).alias("npu"), F.when(k % 2 == 0, dbl("holding")).alias("units"), (F.coalesce(F.when(k % 5 != 0, dbl("fair")), zero) + F.coalesce(F.when(k % 7 != 0, dbl("holding")), zero) - dbl("fair") / 20 - F.when(k % 5 == 0, 90).otherwise(0)).alias("net"))
    rungs = [((F.col("npu") > 0) & (F.col("units") > 0), F.col("npu") * F.col("units"), "units"), (F.col("net") > 1e-9, F.col("net"), "assets")]
    return r.select("val_id", F.round(ladder([(c, v) for c, v, _ in rungs], F.lit(None)), 4).alias("nav"), ladder([(c, F.lit(n)) for c, _, n in rungs], F.lit("none")).alias("rung"))


@query("g60_price_to_level1", "WITH old AS (SELECT holding_id AS company_id, arg_max(fair, (ts, val_id))::DOUBLE AS fair FROM val WHERE methodology = 'click' GROUP BY 1), new AS (SELECT DISTINCT p_partkey AS company_id, round(p_retailprice * p_size, 2) AS fair FROM part JOIN inv ON inv.company_id = p_partkey WHERE status = 'O') SELECT coalesce(new.company_id, old.company_id) AS company_id, coalesce(new.fair, old.fair) AS fair, CASE WHEN new.company_id IS NULL THEN 'kept' WHEN old.company_id IS NULL THEN 'created' ELSE 'updated' END AS outcome FROM old FULL JOIN new USING (company_id)")
def g60(t):
    """A quoted company's price times its shares replaces its level 1 value, or makes one, if an investment in it is active."""
    old = t.val.filter("methodology = 'click'").groupBy(F.col("holding_id").alias("company_id")).agg(dbl(F.max_by("fair", F.struct("ts", "val_id"))).alias("fair"))
    active = t.inv.filter("status = 'O'").select("company_id").distinct()
    new = t.part.select(F.col("p_partkey").alias("company_id"), F.round(F.col("p_retailprice") * F.col("p_size"), 2).alias("fair")).join(active, "company_id", "left_semi")
    return upserted(old, new, ["company_id"])


NAV_POINTS = "pt AS (SELECT sector, strftime(d, '%Y-%m-%d') AS period, sum(fair)::DOUBLE AS nav FROM val JOIN company ON company_id = holding_id GROUP BY 1, 2)"


@query("n03_nav_trend", f"WITH {NAV_POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY period DESC) AS rn FROM pt), p AS (SELECT sector, max(nav) FILTER (rn = 1) AS last, max(nav) FILTER (rn = 2) AS before, max(period) AS period FROM r GROUP BY 1) SELECT sector, period, round(last, 2) AS nav, round((last - before) / abs(nullif(before, 0)) * 100, 2) AS nav_trend_pct FROM p")
def n03(t):
    """Change between the last two points; null with fewer."""
    pt = t.val.groupBy("holding_id", F.date_format("d", "yyyy-MM-dd").alias("period")).agg(F.sum("fair").alias("fair"))
    pt = pt.join(t.company.select(F.col("company_id").alias("holding_id"), "sector"), "holding_id").groupBy("sector", "period").agg(dbl(F.sum("fair")).alias("nav"))
    r = pt.withColumn("rn", F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("period")))).filter("rn <= 2")
    at = lambda i: F.max(F.when(F.col("rn") == i, F.col("nav")))
    p = r.groupBy("sector").agg(at(1).alias("last"), at(2).alias("before"), F.max("period").alias("period"))
    return p.select("sector", "period", F.round("last", 2).alias("nav"), F.round(F.try_divide(F.col("last") - F.col("before"), F.abs(F.nullif("before", F.lit(0.0)))) * 100, 2).alias("nav_trend_pct"))


@query("n07_quoted_unquoted_metrics", f"WITH {LATEST_VAL}, i AS (SELECT company_id, sum(cost)::DOUBLE AS cost FROM inv GROUP BY 1), x AS (SELECT fund, segment = 'BUILDING' AS quoted, i.cost, lv.fv::DOUBLE AS fv FROM company LEFT JOIN i USING (company_id) LEFT JOIN lv ON holding_id = company_id) SELECT fund, {', '.join(f'count(*) FILTER ({c}quoted) AS {n}_count, coalesce(round(sum(cost) FILTER ({c}quoted), 2), 0) AS {n}_cost, coalesce(round(sum(fv) FILTER ({c}quoted), 2), 0) AS {n}_fv' for n, c in (('quoted', ''), ('unquoted', 'NOT ')))} FROM x GROUP BY 1")
def n07(t):
    i = t.inv.groupBy("company_id").agg(F.sum("cost").alias("cost"))
    lv = latest_valuation(t).select(F.col("holding_id").alias("company_id"), "fv")
    x = t.company.join(i, "company_id", "left").join(lv, "company_id", "left").withColumn("quoted", F.col("segment") == "BUILDING")
    of = lambda name, cond: [F.count_if(cond).alias(f"{name}_count"), *[F.coalesce(F.round(dbl(F.sum(F.when(cond, F.col(c)))), 2), F.lit(0.0)).alias(f"{name}_{c}") for c in ("cost", "fv")]]
    return x.groupBy("fund").agg(*of("quoted", F.col("quoted")), *of("unquoted", ~F.col("quoted")))


@query("n08_exit_means", f"WITH RECURSIVE ex AS (SELECT inv_id, n, inv_id * 10 + n AS k, max(r.d) AS d, sum(net) AS net FROM recv r JOIN inv USING (inv_id) WHERE flag = 'R' AND status = 'F' GROUP BY 1, 2), fl AS (SELECT k, inv.d, -inv.cost::DOUBLE AS a FROM ex JOIN inv USING (inv_id) UNION ALL SELECT k, d, net::DOUBLE FROM ex), {irr_sql('fl', 'k')} SELECT fund, count(*) AS exits, round(avg(net::DOUBLE / cost::DOUBLE), 4) AS mean_moic, round(avg(irr), 2) AS mean_irr FROM ex JOIN inv USING (inv_id) JOIN company USING (company_id) LEFT JOIN irr USING (k) GROUP BY 1")
def n08(t):
    """Over actual exits only, each for itself; exits without a rate don't count in its mean."""
    ex = t.recv.filter("flag = 'R'").groupBy("inv_id", "n").agg(F.max("d").alias("xd"), F.sum("net").alias("net"))
    both = ex.join(t.inv.filter("status = 'F'"), "inv_id").select("company_id", (dbl("net") / dbl("cost")).alias("moic"), xirr(F.array(flow(F.col("d"), -F.col("cost")), flow(F.col("xd"), F.col("net")))).alias("irr"))
    per = both.groupBy("company_id").agg(F.count("*").alias("n"), F.sum("moic").alias("m"), F.sum("irr").alias("i"), F.count("irr").alias("k"))
    g = per.join(t.company.select("company_id", "fund"), "company_id").groupBy("fund").agg(*[F.sum(c).alias(c) for c in ("n", "m", "i", "k")])
    return g.select("fund", F.col("n").alias("exits"), F.round(F.try_divide("m", "n"), 4).alias("mean_moic"), F.round(F.try_divide("i", F.nullif("k", F.lit(0))), 2).alias("mean_irr"))


@query("n10_governance_counts", "WITH m AS (SELECT holding_id AS company_id, count(*) AS n FROM val WHERE methodology = 'signup' GROUP BY 1) SELECT fund, coalesce(sum(m.n), 0)::BIGINT AS board_meetings, count(m.company_id) AS companies_with_meetings, count(*) FILTER (segment = 'MACHINERY') AS board_seats, (SELECT count(*) FROM supplier) AS lp_count FROM company LEFT JOIN m USING (company_id) GROUP BY 1")
def n10(t):
    m = t.val.filter("methodology = 'signup'").groupBy(F.col("holding_id").alias("company_id")).agg(F.count("*").alias("n"))
    g = t.company.join(m, "company_id", "left").groupBy("fund").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("board_meetings"), F.count("n").alias("companies_with_meetings"), F.count_if(F.col("segment") == "MACHINERY").alias("board_seats"))
    return g.crossJoin(t.supplier.agg(F.count("*").alias("lp_count")))  # one row


@query("n11_control_counts", "SELECT fund, count(*) FILTER (qty > 10) AS stakes_over_10, count(*) FILTER (abs(gross - net) < gross * 0.05) AS reconciled, coalesce(sum(abs(gross - net)) FILTER (line = 'O'), 0)::DOUBLE AS variance, count(*) FILTER (flag = 'N' AND tax > gross * 0.07) AS reports FROM recv JOIN inv USING (inv_id) JOIN company USING (company_id) GROUP BY 1")
def n11(t):
    c = F.col
    off = F.abs(c("gross") - c("net"))
    counts = [F.count_if(c("qty") > 10).alias("stakes_over_10"), F.count_if(off < c("gross") * F.lit(0.05).cast("decimal(3,2)")).alias("reconciled"), F.sum(F.when(c("line") == "O", off)).alias("variance"), F.count_if((c("flag") == "N") & (c("tax") > c("gross") * F.lit(0.07).cast("decimal(3,2)"))).alias("reports")]
    per = t.recv.groupBy("inv_id").agg(*counts).join(t.inv.select("inv_id", "company_id"), "inv_id").groupBy("company_id").agg(*[F.sum(x).alias(x) for x in ("stakes_over_10", "reconciled", "variance", "reports")])
    g = per.join(t.company.select("company_id", "fund"), "company_id").groupBy("fund")
    return g.agg(F.sum("stakes_over_10").alias("stakes_over_10"), F.sum("reconciled").alias("reconciled"), F.coalesce(dbl(F.sum("variance")), F.lit(0.0)).alias("variance"), F.sum("reports").alias("reports"))


METRICS = {"dpi": "distributed / called", "rvpi": "residual_after_carry / called", "tvpi": "tvpi", "moic": "(realised + residual) / invested", "carry_base": "carry_base", "gross_carry": "gross_carry", "net_carry": "net_carry", "nav": "nav", "uncalled": "greatest(0, committed - called)", "total_called": "called", "total_distributed": "distributed", "total_realised": "realised"}
ZERO_EARLY = ("carry_base", "gross_carry", "net_carry")


@query("n19_metric_map", f"WITH {FRAME}, m AS ({' UNION ALL '.join(f'''SELECT scheme, '{k}' AS metric, round({'CASE WHEN distributed < called THEN coalesce(' + x + ', 0) ELSE ' + x + ' END' if k in ZERO_EARLY else x}, 4) AS value FROM f7''' for k, x in METRICS.items())}) SELECT * FROM m WHERE value IS NOT NULL")
def n19(t):
    """The frame as long rows. While a scheme is still returning capital, carry that isn't known is 0, not missing."""
    c = F.col
    value = {"dpi": c("distributed") / c("called"), "rvpi": c("residual_after_carry") / c("called"), "moic": (c("realised") + c("residual")) / c("invested"), "uncalled": F.when(c("called").isNotNull(), F.greatest(F.lit(0.0), c("committed") - c("called"))).otherwise(0.0), "total_called": c("called"), "total_distributed": c("distributed"), "total_realised": c("realised")}
    early = c("distributed") < c("called")
    held = lambda k: F.when(early, F.coalesce(c(k), F.lit(0.0))).otherwise(c(k)) if k in ZERO_EARLY else value.get(k, c(k) if k not in value else None)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.round(held(k), 4).alias("value")) for k in METRICS]))
    return frame(t).select("scheme", each.alias("x")).select("scheme", "x.metric", "x.value").filter("value is not null")


@query("n22_sector_breakdown", f"WITH {LATEST_VAL}, i AS (SELECT company_id, sum(cost)::DOUBLE AS cost FROM inv GROUP BY 1) SELECT sector, count(*) AS companies, round(coalesce(sum(i.cost), 0), 2) AS cost, round(coalesce(sum(lv.fv)::DOUBLE, 0), 2) AS fv, round(sum(lv.fv)::DOUBLE / nullif(sum(i.cost), 0), 6) AS moic FROM company LEFT JOIN i USING (company_id) LEFT JOIN lv ON holding_id = company_id GROUP BY 1")
def n22(t):
    i = t.inv.groupBy("company_id").agg(F.sum("cost").alias("cost"))
    g = t.company.join(i, "company_id", "left").join(latest_valuation(t).select(F.col("holding_id").alias("company_id"), "fv"), "company_id", "left").groupBy("sector").agg(F.count("*").alias("companies"), F.sum("cost").alias("c"), F.sum("fv").alias("f"))
    return g.select("sector", "companies", F.round(F.coalesce(dbl("c"), F.lit(0.0)), 2).alias("cost"), F.round(F.coalesce(dbl("f"), F.lit(0.0)), 2).alias("fv"), ratio("f", "c", 6).alias("moic"))


@query("p04_cash_flow_rows", "WITH r AS (SELECT inv_id, strftime(d, '%Y-%m') AS period, n, CASE WHEN qty > 25 THEN gross ELSE 0 END AS opening, ['Opening Balance', 'Cash from Operations', 'CAPEX', 'Notes'][n % 4 + 1] AS label, net, part_id, payer_id FROM recv), k AS (SELECT *, CASE label WHEN 'Opening Balance' THEN 'opening_cash' WHEN 'Cash from Operations' THEN 'operating' WHEN 'CAPEX' THEN 'investing' END AS key FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY inv_id, period ORDER BY opening = 0, n, part_id, payer_id, net) AS rn FROM k WHERE key IS NOT NULL) SELECT inv_id, period, key, opening::DOUBLE AS opening, net::DOUBLE AS net FROM o WHERE rn = 1")
def p04(t):
    """Labels become keys, unknown ones go; of a period's rows one with opening cash is preferred, then the first."""
    keys = {"Opening Balance": "opening_cash", "Cash from Operations": "operating", "CAPEX": "investing"}
    label = F.element_at(F.array(*map(F.lit, (*keys, "Notes"))), F.col("n") % 4 + 1)
    key = ladder([(F.col("label") == a, F.lit(b)) for a, b in keys.items()], F.lit(None).cast("string"))
    r = t.recv.select("inv_id", F.date_format("d", "yyyy-MM").alias("period"), "n", F.when(F.col("qty") > 25, F.col("gross")).otherwise(0).alias("opening"), label.alias("label"), "net", "part_id", "payer_id")
    r = r.withColumn("key", key).filter("key is not null")
    best = F.min_by(F.struct("key", dbl("opening").alias("opening"), dbl("net").alias("net")), F.struct(F.col("opening") == 0, "n", "part_id", "payer_id", "net"))
    return r.groupBy("inv_id", "period").agg(best.alias("x")).select("inv_id", "period", "x.*")


@query("p05_company_node", f"WITH {MIS}, {LATEST_VAL}, {KPI}, y AS (SELECT company_id, max(q) AS q, sum(revenue) FILTER (q // 4 = lastq // 4) AS ytd, max(revenue) FILTER (q = lastq) AS last_revenue FROM mis JOIN (SELECT company_id, max(q) - 1 + 1 AS lastq FROM mis GROUP BY 1) USING (company_id) GROUP BY 1), k AS (SELECT company_id, arg_max(value, (ts, val_id)) FILTER (slug = 'revenue') AS revenue, arg_max(value, (ts, val_id)) FILTER (slug = 'mrr') AS mrr FROM kpi GROUP BY 1), i AS (SELECT company_id, sum(cost)::DOUBLE AS cost FROM inv GROUP BY 1) SELECT c.company_id, i.cost, lv.fv::DOUBLE AS fv, round(lv.fv::DOUBLE / nullif(i.cost, 0), 6) AS moic, round(y.ytd, 2) AS ytd_revenue, round(coalesce(nullif(y.last_revenue, 0), k.revenue, k.mrr * 12), 2) AS revenue FROM company c LEFT JOIN i USING (company_id) LEFT JOIN lv ON holding_id = company_id LEFT JOIN y USING (company_id) LEFT JOIN k USING (company_id)")
def p05(t):
    """Cost of the tranches, newest value, the year's sums, the newest quarter; its revenue from readings where it has none: revenue, then recurring revenue times twelve."""
    m = mis(t)
    last = m.groupBy("company_id").agg(F.max("q").alias("lastq"))
    y = m.join(last, "company_id").groupBy("company_id").agg(F.sum(F.when(F.floor(F.col("q") / 4) == F.floor(F.col("lastq") / 4), F.col("revenue"))).alias("ytd"), F.max(F.when(F.col("q") == F.col("lastq"), F.col("revenue"))).alias("last_revenue"))
    newest = lambda s, name: F.max_by(F.when(F.col("slug") == s, F.col("value")), F.when(F.col("slug") == s, F.struct("ts", "val_id"))).alias(name)
    k = kpi(t).filter(F.col("slug").isin("revenue", "mrr")).groupBy("company_id").agg(newest("revenue", "k_revenue"), newest("mrr", "k_mrr"))
    i = t.inv.groupBy("company_id").agg(dbl(F.sum("cost")).alias("cost"))
    j = t.company.select("company_id").join(i, "company_id", "left").join(latest_valuation(t).select(F.col("holding_id").alias("company_id"), dbl("fv").alias("fv")), "company_id", "left").join(y, "company_id", "left").join(k, "company_id", "left")
    revenue = F.coalesce(F.nullif(F.col("last_revenue"), F.lit(0.0)), "k_revenue", F.col("k_mrr") * 12)
    return j.select("company_id", "cost", "fv", ratio("fv", "cost", 6).alias("moic"), F.round("ytd", 2).alias("ytd_revenue"), F.round(revenue, 2).alias("revenue"))


@query("p07_stuck_imports", "SELECT inv_id AS job_id, i.d AS started, count(r.n) FILTER (flag = 'A') AS calls, count(r.n) FILTER (flag = 'N') AS valuations, count(r.n) FILTER (flag = 'R') AS exits FROM inv i LEFT JOIN recv r USING (inv_id) WHERE status = 'P' AND i.d < DATE '1999-01-01' GROUP BY 1, 2")
def p07(t):
    """Jobs that are still running though they began long ago, with what each has written already."""
    of = lambda f, name: F.coalesce(F.col(f), F.lit(0)).alias(name)
    written = t.recv.groupBy("inv_id").agg(*[F.count_if(F.col("flag") == f).alias(f) for f in "ANR"])
    stuck = t.inv.filter("status = 'P' and d < date'1999-01-01'")
    return stuck.join(written, "inv_id", "left").select(F.col("inv_id").alias("job_id"), F.col("d").alias("started"), of("A", "calls"), of("N", "valuations"), of("R", "exits"))


#: Labels and units of readings; those that aren't listed have none.
LABELS = (("revenue", "Revenue", "INR"), ("ebitda-margin", "EBITDA margin", "percent"), ("runway-months", "Runway", "months"), ("dscr", "Debt cover", "x"), ("mrr", "Recurring revenue", "INR"))


@query("p08_metrics_with_labels", f"WITH {KPI}, meta(slug, label, unit) AS (VALUES {', '.join(map(str, LABELS))}) SELECT company_id, k.slug, coalesce(label, k.slug) AS label, unit, value FROM (SELECT company_id, slug, arg_max(value, (ts, val_id)) AS value FROM kpi GROUP BY 1, 2) k LEFT JOIN meta USING (slug)")
def p08(t):
    meta = t.spark.createDataFrame(LABELS, "slug string, label string, unit string")
    newest = kpi(t).groupBy("company_id", "slug").agg(F.max_by("value", F.struct("ts", "val_id")).alias("value"))
    return newest.join(F.broadcast(meta), "slug", "left").select("company_id", "slug", F.coalesce("label", "slug").alias("label"), "unit", "value")  # five rows


@query("p16_cash_flow_fallback", "WITH b AS (SELECT company_id, 'budget' AS source, stage AS kind, sum(cost)::DOUBLE AS amount FROM inv WHERE year(d) = 2000 GROUP BY 1, 3), l AS (SELECT company_id, 'ledger' AS source, flag AS kind, sum(gross)::DOUBLE AS amount FROM recv JOIN inv USING (inv_id) GROUP BY 1, 3) SELECT * FROM b UNION ALL SELECT * FROM l WHERE company_id NOT IN (SELECT company_id FROM b)")
def p16(t):
    """A company's budgeted cash flow; one without any gets its ledger's totals by type."""
    b = t.inv.filter(F.year("d") == 2000).groupBy("company_id", F.col("stage").alias("kind")).agg(F.sum("cost").alias("amount"))
    per = t.recv.groupBy("inv_id", F.col("flag").alias("kind")).agg(F.sum("gross").alias("amount")).join(t.inv.select("inv_id", "company_id"), "inv_id").groupBy("company_id", "kind").agg(F.sum("amount").alias("amount"))
    out = lambda df, s: df.select("company_id", F.lit(s).alias("source"), "kind", dbl("amount").alias("amount"))
    return out(b, "budget").unionByName(out(per.join(b.select("company_id").distinct(), "company_id", "left_anti"), "ledger"))


@query("p21_kpi_submission_upsert", f"WITH {KPI}, s AS (SELECT company_id, slug, strftime(ts, '%Y-%m') AS period, arg_max(value, (ts, val_id)) AS value FROM kpi WHERE val_id % 2 = 0 GROUP BY 1, 2, 3), n AS (SELECT company_id, slug, strftime(ts, '%Y-%m') AS period, arg_max(value, (ts, val_id)) AS value FROM kpi WHERE val_id % 5 = 1 OR val_id % 12 = 4 GROUP BY 1, 2, 3) SELECT company_id, slug, period, coalesce(n.value, s.value) AS value, CASE WHEN n.slug IS NULL THEN 'kept' WHEN s.slug IS NULL THEN 'created' ELSE 'updated' END AS outcome FROM s FULL JOIN n USING (company_id, slug, period)")
def p21(t):
    """Readings of a company, figure and month: the submitted one replaces what is stored."""
    keys = ["company_id", "slug", "period"]
    rows = kpi(t).withColumn("period", F.date_format("ts", "yyyy-MM"))
    newest = lambda df: df.groupBy(*keys).agg(F.max_by("value", F.struct("ts", "val_id")).alias("value"))
    return upserted(newest(rows.filter("val_id % 2 = 0")), newest(rows.filter("val_id % 5 = 1 or val_id % 12 = 4")), keys)


@query("p22_recompute_active", f"WITH RECURSIVE {FLOWS}, act AS (SELECT fl.* FROM fl JOIN inv USING (inv_id) WHERE status = 'O'), {irr_sql('act', 'inv_id')} SELECT a.inv_id, irr, round(sum(a) FILTER (a > 0) / nullif(-sum(a) FILTER (a < 0), 0), 4) AS moic FROM act a LEFT JOIN irr USING (inv_id) GROUP BY 1, 2")
def p22(t):
    """Rate and multiple of all active investments in one batch."""
    g = flows(t).join(t.inv.filter("status = 'O'").select("inv_id"), "inv_id", "left_semi").groupBy("inv_id").agg(F.collect_list("f").alias("f"))
    summed = lambda keep: F.aggregate(F.filter("f", keep), F.lit(0.0), lambda s, x: s + x["a"])
    return g.select("inv_id", xirr(F.col("f")).alias("irr"), F.round(F.try_divide(F.nullif(summed(lambda x: x["a"] > 0), F.lit(0.0)), F.nullif(-summed(lambda x: x["a"] < 0), F.lit(0.0))), 4).alias("moic"))


FIGURES = ("revenue", "working-capital-ratio", "cash-balance", "revenue-plan")


@query("k10_submission_completeness", f"WITH {KPI}, h AS (SELECT company_id, list_sort(list(DISTINCT slug) FILTER (slug IN {FIGURES})) AS has FROM kpi GROUP BY 1) SELECT c.company_id, len(coalesce(has, [])) AS submitted, array_to_string(list_filter([{', '.join(repr(x) for x in sorted(FIGURES))}], lambda x: NOT list_contains(coalesce(has, []), x)), ',') AS missing, round(len(coalesce(has, [])) * 100.0 / 4, 1) AS pct FROM company c LEFT JOIN h USING (company_id)")
def k10(t):
    """Which of the four statements a company has sent."""
    flags = kpi(t).filter(F.col("slug").isin(*FIGURES)).groupBy("company_id").agg(*[F.max(F.col("slug") == s).alias(s) for s in FIGURES])
    j = t.company.select("company_id").join(flags, "company_id", "left").select("company_id", *[F.coalesce(F.col(f"`{s}`"), F.lit(False)).alias(s) for s in FIGURES])
    n = sum((F.col(f"`{s}`").cast("int") for s in FIGURES[1:]), F.col(f"`{FIGURES[0]}`").cast("int"))
    missing = F.concat_ws(",", *[F.when(~F.col(f"`{s}`"), s) for s in sorted(FIGURES)])
    return j.select("company_id", n.cast("long").alias("submitted"), missing.alias("missing"), F.round(n * 100.0 / 4, 1).alias("pct"))


@query("e09_call_numbers", "WITH c AS (SELECT company_id, inv_id, d, CASE WHEN inv_id % 3 <> 0 THEN inv_id % 50 + 1 END AS stated FROM inv) SELECT inv_id, coalesce(stated, row_number() OVER (PARTITION BY company_id ORDER BY d, inv_id)) AS call_number, stated IS NULL AS by_position FROM c")
def e09(t):
    """A call's own number, else its place among the company's calls by date."""
    stated = F.when(F.col("inv_id") % 3 != 0, F.col("inv_id") % 50 + 1)
    place = F.row_number().over(Window.partitionBy("company_id").orderBy("d", "inv_id"))
    return t.inv.select("inv_id", F.coalesce(stated, place.cast("long")).alias("call_number"), stated.isNull().alias("by_position"))


@query("p23_risk_batch", f"WITH {KPI}, k AS (SELECT company_id, count(*) AS readings FROM kpi GROUP BY 1), s AS ({ORACLES['g52_ten_signals']}) SELECT s.company_id, coalesce(readings, 0) AS readings, score, tier FROM s LEFT JOIN k USING (company_id)")
def p23(t):
    """The ten-signal score of all companies in one batch, not of the first fifty only, with how many readings it rests on."""
    k = kpi(t).groupBy("company_id").agg(F.count("*").alias("readings"))
    return g52(t).join(k, "company_id", "left").select("company_id", F.coalesce("readings", F.lit(0)).alias("readings"), "score", "tier")
