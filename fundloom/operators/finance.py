"""Fund calculators: rates, multiples, waterfalls, NAV, fees, statements, valuations, scores (inventory G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import dcf, flow, preferred, xirr
from ..registry import query
from ..sources.tables import AS_OF, dbl, ratio, total
from .relational import LATEST_VAL, latest_valuation

HURDLE, CARRY, FEE, GST = 0.08, 0.20, 0.02, 0.18


def as_of():
    return F.lit(AS_OF).cast("date")


# Flows of an investment: its cost, its receipts of each day, and, if it is active, its cost as what it is still worth.
FLOWS = f"""fl AS (SELECT inv_id, d, -cost::DOUBLE AS a FROM inv UNION ALL SELECT inv_id, d, sum(net)::DOUBLE FROM recv GROUP BY 1, 2 UNION ALL SELECT inv_id, DATE '{AS_OF}', cost::DOUBLE FROM inv WHERE status = 'O')"""


def irr_sql(flows: str, key: str, expand: bool = True) -> str:
    """The same bisection as recursive SQL, as tables ending in irr(key, irr)."""
    stop = "1e-9" if expand else "1e-6"
    highs = ", ".join(str(10.0 * 4**k) for k in range(10 if expand else 1))
    return f"""g AS (SELECT {key}, min(d) AS d0, list({{'t': date_diff('day', z.d0, d) / 365.25::DOUBLE, 'a': a}}) AS f, max(a) > 0 AND min(a) < 0 AS signs FROM {flows} JOIN (SELECT {key}, min(d) AS d0 FROM {flows} WHERE a <> 0 GROUP BY 1) z USING ({key}) WHERE a <> 0 GROUP BY 1),
  b0 AS (SELECT {key}, f, list_sum(list_transform(f, lambda x: x.a / pow(1 - 0.99::DOUBLE, x.t))) AS at_low FROM g WHERE signs),
  b1 AS (SELECT {key}, f, at_low, list_filter([{highs}]::DOUBLE[], lambda h: list_sum(list_transform(f, lambda x: x.a / pow(1 + h, x.t))) * at_low <= 0)[1] AS hi FROM b0),
  bis AS (SELECT {key}, f, at_low, -0.99::DOUBLE AS lo, hi, 0 AS i FROM b1 WHERE hi IS NOT NULL
  UNION ALL SELECT {key}, f, at_low, CASE WHEN v * at_low <= 0 AND abs(v) >= {stop} THEN lo ELSE mid END, CASE WHEN v * at_low <= 0 OR abs(v) < {stop} THEN mid ELSE hi END, i + 1 FROM (SELECT *, (lo + hi) / 2 AS mid, list_sum(list_transform(f, lambda x: x.a / pow(1 + (lo + hi) / 2, x.t))) AS v FROM bis WHERE i < 80)),
  irr AS (SELECT {key}, round((lo + hi) / 2 * 100, 4) + 0.0::DOUBLE AS irr FROM bis WHERE i = 80)"""


def flows(t):
    out = t.inv.select("inv_id", flow(F.col("d"), -F.col("cost")).alias("f"))
    got = t.recv.groupBy("inv_id", "d").agg(F.sum("net").alias("a")).select("inv_id", flow(F.col("d"), F.col("a")).alias("f"))
    left = t.inv.filter("status = 'O'").select("inv_id", flow(as_of(), F.col("cost")).alias("f"))
    return out.unionByName(got).unionByName(left)


#: The rate of all flows of a company's investments, as tables ending in irr(company_id, irr).
COMPANY_RATES = f"{FLOWS}, cfl AS (SELECT company_id, fl.d, fl.a FROM fl JOIN inv USING (inv_id)), {irr_sql('cfl', 'company_id')}"


def company_rates(t):
    """company_id and irr, null outside -99.99 to 999.99."""
    f = flows(t).join(t.inv.select("inv_id", "company_id"), "inv_id").groupBy("company_id").agg(F.collect_list("f").alias("f")).select("company_id", xirr(F.col("f")).alias("irr"))
    return f.select("company_id", F.when(F.col("irr").between(-99.99, 999.99), F.col("irr")).alias("irr"))


@query("g01_xirr", f"WITH RECURSIVE {FLOWS}, {irr_sql('fl', 'inv_id')} SELECT DISTINCT fl.inv_id, irr FROM fl LEFT JOIN irr USING (inv_id)")
def g01(t):
    return flows(t).groupBy("inv_id").agg(F.collect_list("f").alias("f")).select("inv_id", xirr(F.col("f")).alias("irr"))


@query("g02_xirr_no_expansion", f"WITH RECURSIVE {FLOWS}, {irr_sql('fl', 'inv_id', False)} SELECT inv_id, irr FROM inv LEFT JOIN irr USING (inv_id) WHERE status = 'O'")
def g02(t):
    """For active holdings only; null where -99 % to 1000 % holds no root."""
    active = flows(t).join(t.inv.filter("status = 'O'").select("inv_id"), "inv_id", "left_semi")
    return active.groupBy("inv_id").agg(F.collect_list("f").alias("f")).select("inv_id", xirr(F.col("f"), expand=False).alias("irr"))


@query("g06_investment_irr_moic", f"""WITH RECURSIVE {FLOWS}, {irr_sql('fl', 'inv_id')}, m AS (SELECT inv_id, round(sum(a) FILTER (a > 0) / nullif(-sum(a) FILTER (a < 0), 0), 4) AS moic FROM fl GROUP BY 1)
  SELECT m.inv_id, CASE WHEN irr BETWEEN -99.99 AND 999.99 THEN irr END AS irr, CASE WHEN moic BETWEEN 0 AND 100 THEN moic END AS moic FROM m LEFT JOIN irr USING (inv_id)""")
def g06(t):
    g = flows(t).groupBy("inv_id").agg(F.collect_list("f").alias("f"))
    summed = lambda keep: F.aggregate(F.filter("f", keep), F.lit(0.0), lambda s, x: s + x["a"])
    moic = F.round(F.try_divide(F.nullif(summed(lambda x: x["a"] > 0), F.lit(0.0)), F.nullif(-summed(lambda x: x["a"] < 0), F.lit(0.0))), 4)
    g = g.select("inv_id", xirr(F.col("f")).alias("irr"), moic.alias("moic"))
    return g.select("inv_id", F.when(F.col("irr").between(-99.99, 999.99), F.col("irr")).alias("irr"), F.when(F.col("moic").between(0, 100), F.col("moic")).alias("moic"))


@query("g07_exit_irr", f"WITH RECURSIVE ex AS (SELECT inv_id, n, inv_id * 10 + n AS k, max(d) AS d, sum(net) AS net FROM recv WHERE flag = 'R' GROUP BY 1, 2), fl AS (SELECT k, inv.d, -inv.cost::DOUBLE AS a FROM ex JOIN inv USING (inv_id) UNION ALL SELECT k, d, net::DOUBLE FROM ex), {irr_sql('fl', 'k')} SELECT ex.inv_id, ex.n::INT AS n, irr FROM ex JOIN inv USING (inv_id) LEFT JOIN irr USING (k)")
def g07(t):
    """Of each exit on its own: all that was paid in against that one receipt."""
    ex = t.recv.filter("flag = 'R'").groupBy("inv_id", "n").agg(F.max("d").alias("xd"), F.sum("net").alias("net"))
    both = ex.join(t.inv.select("inv_id", "d", "cost"), "inv_id")
    return both.select("inv_id", F.col("n").cast("int").alias("n"), xirr(F.array(flow(F.col("d"), -F.col("cost")), flow(F.col("xd"), F.col("net")))).alias("irr"))


# One row a fund of all the sums that its metrics are made from.
BASE = f"""{LATEST_VAL}, r1 AS (SELECT inv_id, sum(net) AS net, sum(gross) AS gross, sum(net) FILTER (flag = 'R') AS exits FROM recv GROUP BY 1),
fb AS (SELECT fund, sum(i.cost) AS called, sum(r1.net) AS distributed, sum(CASE WHEN i.status = 'F' THEN r1.net END) AS realised, sum(CASE WHEN i.status = 'O' THEN i.cost END) AS active_fv, sum(i.cost) * 1.25 AS committed, count(*) AS n FROM inv i JOIN company USING (company_id) LEFT JOIN r1 USING (inv_id) GROUP BY 1),
cv AS (SELECT fund, sum(fv) AS fv, sum(fair) AS fair, sum(cash) AS cash FROM company LEFT JOIN lv ON lv.holding_id = company_id GROUP BY 1)"""


def base(t):
    """fund, called, distributed, realised, active_fv, committed, n: everything is summed to the investment before it moves."""
    r1 = t.recv.groupBy("inv_id").agg(F.sum("net").alias("net"))
    by_company = t.inv.join(r1, "inv_id", "left").groupBy("company_id").agg(F.sum("cost").alias("c"), F.sum("net").alias("r"), F.sum(F.when(F.col("status") == "F", F.col("net"))).alias("x"), F.sum(F.when(F.col("status") == "O", F.col("cost"))).alias("a"), F.count("*").alias("k"))
    g = by_company.join(t.company, "company_id").groupBy("fund")
    return g.agg(F.sum("c").alias("called"), F.sum("r").alias("distributed"), F.sum("x").alias("realised"), F.sum("a").alias("active_fv"), (F.sum("c") * F.lit(1.25).cast("decimal(3,2)")).alias("committed"), F.sum("k").alias("n"))


def marks(t):
    return t.company.join(latest_valuation(t).withColumnRenamed("holding_id", "company_id"), "company_id", "left").groupBy("fund").agg(F.sum("fv").alias("fv"), F.sum("fair").alias("fair"), F.sum("cash").alias("cash"))


@query("g04_fund_markup", f"WITH {BASE} SELECT fund, coalesce(round(active_fv::DOUBLE / nullif(called, 0)::DOUBLE, 6), 1.0) AS markup FROM fb")
def g04(t):
    return base(t).select("fund", F.coalesce(ratio("active_fv", "called", 6), F.lit(1.0)).alias("markup"))


@query("g05_current_fv_chain", f"WITH {LATEST_VAL} SELECT company_id, coalesce(lv.fv, nullif(cash, 0) * 0.1, 0)::DOUBLE AS fv FROM company LEFT JOIN lv ON lv.holding_id = company_id")
def g05(t):
    lv = latest_valuation(t).select(F.col("holding_id").alias("company_id"), "fv")
    return t.company.join(lv, "company_id", "left").select("company_id", dbl(F.coalesce("fv", F.nullif("cash", F.lit(0).cast("decimal(18,2)")) * F.lit(0.1).cast("decimal(2,1)"), F.lit(0))).alias("fv"))


@query("g11_22_fund_aggregates", f"""WITH {BASE} SELECT fund, called::DOUBLE AS called, distributed::DOUBLE AS distributed, coalesce(realised, 0)::DOUBLE AS realised, coalesce(active_fv, 0)::DOUBLE AS active_fv, fv::DOUBLE AS marked_fv, greatest(committed - called, 0)::DOUBLE AS uncalled,
  round(distributed::DOUBLE / called::DOUBLE, 4) AS dpi, round(active_fv::DOUBLE / called::DOUBLE, 4) AS rvpi, CASE WHEN distributed > 0 THEN round((distributed + active_fv)::DOUBLE / called::DOUBLE, 4) END AS tvpi, 'distributions' AS tvpi_method FROM fb JOIN cv USING (fund)""")
def g11(t):
    b = base(t).join(marks(t), "fund")
    tvpi = F.when(F.col("distributed") > 0, ratio(F.col("distributed") + F.col("active_fv"), "called"))
    return b.select(
        "fund", dbl("called").alias("called"), dbl("distributed").alias("distributed"), F.coalesce(dbl("realised"), F.lit(0.0)).alias("realised"), F.coalesce(dbl("active_fv"), F.lit(0.0)).alias("active_fv"), dbl("fv").alias("marked_fv"),
        dbl(F.greatest(F.col("committed") - F.col("called"), F.lit(0))).alias("uncalled"), ratio("distributed", "called").alias("dpi"), ratio("active_fv", "called").alias("rvpi"), tvpi.alias("tvpi"), F.lit("distributions").alias("tvpi_method"),
    )


@query("g15_moic_fund", f"WITH {BASE} SELECT fund, round((coalesce(realised, 0) + coalesce(active_fv, 0))::DOUBLE / called::DOUBLE, 4) AS moic FROM fb")
def g15(t):
    return base(t).select("fund", ratio(F.coalesce("realised", F.lit(0)) + F.coalesce("active_fv", F.lit(0)), "called").alias("moic"))


@query("g19_net_irr", f"""WITH RECURSIVE {BASE}, fl AS (SELECT fund, d, -sum(cost)::DOUBLE AS a FROM inv JOIN company USING (company_id) GROUP BY 1, 2 UNION ALL SELECT fund, r.d, sum(r.net)::DOUBLE FROM recv r JOIN inv USING (inv_id) JOIN company USING (company_id) GROUP BY 1, 2
  UNION ALL SELECT fund, DATE '{AS_OF}', active_fv::DOUBLE FROM fb), {irr_sql('fl', 'fund')} SELECT fb.fund, CASE WHEN abs(irr) <= 500 THEN irr END AS net_irr FROM fb LEFT JOIN irr USING (fund)""")
def g19(t):
    """Of a fund's calls, distributions and what it still holds; flows of a day are one flow."""
    owner = t.inv.select("inv_id", "company_id").join(t.company.select("company_id", "fund"), "company_id")
    calls = t.inv.join(t.company, "company_id").groupBy("fund", "d").agg((-F.sum("cost")).cast("double").alias("a"))
    got = t.recv.groupBy("inv_id", "d").agg(F.sum("net").alias("net")).join(owner, "inv_id").groupBy("fund", "d").agg(F.sum("net").cast("double").alias("a"))
    left = base(t).select("fund", as_of().alias("d"), dbl("active_fv").alias("a"))
    g = calls.unionByName(got).unionByName(left).groupBy("fund").agg(F.collect_list(F.struct("d", "a")).alias("f"))  # one flow a day
    return g.withColumn("irr", xirr(F.col("f"))).select("fund", F.when(F.abs("irr") <= 500, F.col("irr")).alias("net_irr"))


@query("g20_nav_build_up", f"WITH {BASE} SELECT fund, round(realised::DOUBLE + active_fv::DOUBLE + cash::DOUBLE - called::DOUBLE * 0.02, 2) AS nav, round((realised::DOUBLE + active_fv::DOUBLE + cash::DOUBLE - called::DOUBLE * 0.02) * 100 / (n * 1000)::DOUBLE, 4) AS nav_per_unit FROM fb JOIN cv USING (fund)")
def g20(t):
    """Null if a component is unknown."""
    b = base(t).join(marks(t), "fund")
    nav = dbl("realised") + dbl("active_fv") + dbl("cash") - dbl("called") * F.lit(FEE)
    return b.select("fund", F.round(nav, 2).alias("nav"), F.round(nav * 100 / dbl(F.col("n") * 1000), 4).alias("nav_per_unit"))


CALLS = f"""cp AS (SELECT fund, sum(cost)::DOUBLE AS called, sum(cost::DOUBLE * (pow(1.08::DOUBLE, date_diff('day', d, DATE '{AS_OF}') / 365.25::DOUBLE) - 1)) AS pref FROM inv JOIN company USING (company_id) GROUP BY 1)"""


@query("g08_european_waterfall", f"""WITH {BASE}, {CALLS}, w AS (SELECT fund, cp.called, distributed::DOUBLE AS dist, active_fv::DOUBLE AS fv, pref, least(cp.called, distributed::DOUBLE) AS roc, greatest(0, distributed::DOUBLE + active_fv::DOUBLE - cp.called) AS carry_base FROM cp JOIN fb USING (fund)),
  x AS (SELECT *, least(pref * 0.2 / 0.8, greatest(0, dist - roc - pref)) AS catch_up, 0.2 * carry_base AS gross FROM w), y AS (SELECT *, greatest(0, dist - roc - pref - catch_up) AS rest FROM x), z AS (SELECT *, greatest(0, catch_up + 0.2 * rest - gross) AS clawback FROM y)
  SELECT fund, round(roc, 2) AS roc, round(pref, 2) AS pref, round(carry_base, 2) AS carry_base, round(catch_up, 2) AS catch_up, round(gross, 2) AS gross_carry, round(0.8 * rest, 2) AS step4_lp, round(0.2 * rest, 2) AS step4_gp, round(clawback, 2) AS clawback, round(gross - clawback, 2) AS net_carry FROM z""")
def g08(t):
    days = F.datediff(as_of(), "d")
    by_day = t.inv.join(t.company, "company_id").groupBy("fund", "d").agg(F.sum("cost").alias("c"))
    cp = by_day.groupBy("fund").agg(F.sum(preferred(dbl("c"), F.lit(HURDLE), days)).alias("pref"))
    c = F.col
    w = base(t).join(cp, "fund").select("fund", dbl("called").alias("called"), dbl("distributed").alias("dist"), dbl("active_fv").alias("fv"), "pref")
    w = w.withColumn("roc", F.least("called", "dist")).withColumn("carry_base", F.greatest(F.lit(0.0), c("dist") + c("fv") - c("called")))
    left = c("dist") - c("roc") - c("pref")
    w = w.withColumn("catch_up", F.least(c("pref") * CARRY / (1 - CARRY), F.greatest(F.lit(0.0), left))).withColumn("gross_carry", CARRY * c("carry_base"))
    w = w.withColumn("rest", F.greatest(F.lit(0.0), left - c("catch_up"))).withColumn("step4_lp", (1 - CARRY) * c("rest")).withColumn("step4_gp", CARRY * c("rest"))
    w = w.withColumn("clawback", F.greatest(F.lit(0.0), c("catch_up") + c("step4_gp") - c("gross_carry"))).withColumn("net_carry", c("gross_carry") - c("clawback"))
    return w.select("fund", *[F.round(k, 2).alias(k) for k in ("roc", "pref", "carry_base", "catch_up", "gross_carry", "step4_lp", "step4_gp", "clawback", "net_carry")])


@query("g09_fill_if_empty", f"WITH {BASE} SELECT fund, coalesce(nullif(CASE WHEN fund < 'B' THEN 0 WHEN fund < 'F' THEN called * 0.5 END, 0), distributed)::DOUBLE AS total_distributed FROM fb")
def g09(t):
    said = F.when(F.col("fund") < "B", F.lit(0).cast("decimal(30,4)")).when(F.col("fund") < "F", (F.col("called") * F.lit(0.5).cast("decimal(2,1)")).cast("decimal(30,4)"))
    return base(t).select("fund", dbl(F.coalesce(F.nullif(said, F.lit(0).cast("decimal(30,4)")), "distributed")).alias("total_distributed"))


@query("g23_carry_variants", "SELECT company_id, arg_min(cost, (CASE stage WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, inv_id))::DOUBLE AS gross, greatest(arg_min(cost, (CASE stage WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, inv_id)) - 100000, 0)::DOUBLE AS net FROM inv GROUP BY 1")
def g23(t):
    """Of the variants of a figure the default one, else an untagged one, else any."""
    rank = F.when(F.col("stage") == "1-URGENT", 0).when(F.col("stage") == "2-HIGH", 1).otherwise(2)
    g = t.inv.groupBy("company_id").agg(F.min_by("cost", F.struct(rank, "inv_id")).alias("g"))
    return g.select("company_id", dbl("g").alias("gross"), dbl(F.greatest(F.col("g") - 100000, F.lit(0))).alias("net"))


LEGS = """leg AS (SELECT flag || 'D' AS account, gross AS debit, 0::DECIMAL(18,2) AS credit, d FROM recv UNION ALL SELECT line || 'C', 0, gross, d FROM recv)"""


def legs(t):
    """A ledger row is two legs: what is debited and what is credited."""
    zero = F.lit(0).cast("decimal(18,2)")
    leg = F.array(F.struct(F.concat("flag", F.lit("D")).alias("account"), F.col("gross").alias("debit"), zero.alias("credit")), F.struct(F.concat("line", F.lit("C")).alias("account"), zero.alias("debit"), F.col("gross").alias("credit")))
    return t.recv.select("d", F.explode(leg).alias("leg")).select("d", "leg.*")


@query("d06_trial_balance", f"WITH {LEGS}, g AS (SELECT account, sum(debit) AS debit, sum(credit) AS credit FROM leg GROUP BY 1) SELECT account, debit::DOUBLE AS debit, credit::DOUBLE AS credit, abs(debit - credit)::DOUBLE AS net, CASE WHEN debit >= credit THEN 'Dr' ELSE 'Cr' END AS side, (SELECT abs(sum(debit) - sum(credit)) < 0.01 FROM g) AS balanced FROM g")
def d06(t):
    g = legs(t).groupBy("account").agg(F.sum("debit").alias("x"), F.sum("credit").alias("y"))
    even = g.agg((F.abs(F.sum("x") - F.sum("y")) < 0.01).alias("balanced"))
    return g.crossJoin(even).select("account", dbl("x").alias("debit"), dbl("y").alias("credit"), dbl(F.abs(F.col("x") - F.col("y"))).alias("net"), F.when(F.col("x") >= F.col("y"), "Dr").otherwise("Cr").alias("side"), "balanced")  # one row


@query("d07_balance_by_side", f"WITH {LEGS} SELECT account, abs(sum(CASE WHEN account LIKE '%D' THEN debit - credit ELSE credit - debit END))::DOUBLE AS balance FROM leg WHERE d <= DATE '1998-12-31' GROUP BY 1 HAVING sum(debit) <> sum(credit)")
def d07(t):
    signed = F.when(F.col("account").endswith("D"), F.col("debit") - F.col("credit")).otherwise(F.col("credit") - F.col("debit"))
    g = legs(t).filter("d <= date'1998-12-31'").groupBy("account").agg(F.sum(signed).alias("b"))
    return g.filter("b <> 0").select("account", dbl(F.abs("b")).alias("balance"))


@query("g24_nav_from_ledger", f"""WITH {BASE}, led AS (SELECT fund, sum(CASE WHEN flag = 'R' THEN r.net ELSE 0 END) AS cash, sum(CASE WHEN flag = 'A' THEN r.tax ELSE 0 END) AS fees, sum(CASE WHEN flag = 'N' AND line = 'F' THEN r.tax ELSE 0 END) AS liab FROM recv r JOIN inv USING (inv_id) JOIN company USING (company_id) GROUP BY 1)
  SELECT fund, greatest(active_fv + greatest(cash, 0) - abs(fees) - abs(liab), 0)::DOUBLE AS nav FROM fb JOIN led USING (fund)""")
def g24(t):
    of = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0))
    per = t.recv.groupBy("inv_id").agg(of(F.col("flag") == "R", "net").alias("cash"), of(F.col("flag") == "A", "tax").alias("fees"), of((F.col("flag") == "N") & (F.col("line") == "F"), "tax").alias("liab"))
    led = per.join(t.inv, "inv_id").join(t.company.drop("cash"), "company_id").groupBy("fund").agg(*[F.sum(c).alias(c) for c in ("cash", "fees", "liab")])
    nav = F.greatest(F.col("active_fv") + F.greatest("cash", F.lit(0)) - F.abs("fees") - F.abs("liab"), F.lit(0))
    return base(t).join(led, "fund").select("fund", dbl(nav).alias("nav"))


@query("g25_management_fee", f"WITH {BASE}, q(quarter, days) AS (VALUES ('Q1', 90), ('Q2', 91), ('Q3', 92), ('Q4', 92)) SELECT fund, quarter, round(called * 0.02 * days / 365, 2)::DOUBLE AS fee, round(round(called * 0.02 * days / 365, 2) * 0.18, 2)::DOUBLE AS gst FROM (SELECT fund, called::DOUBLE AS called FROM fb), q")
def g25(t):
    """Basis times rate times days over 365, half up to 2 digits; GST on the rounded fee."""
    days = F.explode(F.array(*[F.struct(F.lit(f"Q{i + 1}").alias("quarter"), F.lit(n).alias("days")) for i, n in enumerate((90, 91, 92, 92))]))
    fee = F.round(dbl("called") * FEE * F.col("q.days") / 365, 2)
    return base(t).select("fund", "called", days.alias("q")).select("fund", "q.quarter", fee.alias("fee"), F.round(fee * GST, 2).alias("gst"))


@query("g26_clawback_at_close", f"WITH {BASE}, w AS (SELECT fund, called::DOUBLE AS drawn, distributed::DOUBLE AS dist FROM fb), x AS (SELECT *, greatest(dist - drawn - drawn * 0.08 * 5, 0) * 0.2 AS owed FROM w) SELECT fund, round(drawn * 0.08 * 5, 2) AS pref, round(owed, 2) AS owed, round(abs(owed - dist * 0.01), 2) AS difference, CASE WHEN dist * 0.01 > owed THEN 'gp owes' ELSE 'lp owes' END AS direction FROM x")
def g26(t):
    """Simple hurdle over five years; carry paid so far is a hundredth of the distributions."""
    c = F.col
    w = base(t).select("fund", dbl("called").alias("drawn"), dbl("distributed").alias("dist")).withColumn("pref", c("drawn") * HURDLE * 5)
    w = w.withColumn("owed", F.greatest(c("dist") - c("drawn") - c("pref"), F.lit(0.0)) * CARRY)
    paid = c("dist") * 0.01
    return w.select("fund", F.round("pref", 2).alias("pref"), F.round("owed", 2).alias("owed"), F.round(F.abs(c("owed") - paid), 2).alias("difference"), F.when(paid > c("owed"), "gp owes").otherwise("lp owes").alias("direction"))


@query("g27_waterfall_simulator", f"WITH {BASE}, s(years) AS (SELECT unnest([1, 3, 5, 7])), w AS (SELECT fund, years, called::DOUBLE AS drawn, distributed::DOUBLE AS dist, called::DOUBLE * (pow(1.08::DOUBLE, years::DOUBLE) - 1) AS pref FROM fb, s) SELECT fund, years::INT AS years, round(pref, 2) AS pref, round(greatest(dist - drawn - pref, 0) * 0.2, 2) AS carry FROM w")
def g27(t):
    """Compound hurdle, no catch-up."""
    w = base(t).select("fund", dbl("called").alias("drawn"), dbl("distributed").alias("dist"), F.explode(F.array(*map(F.lit, (1, 3, 5, 7)))).alias("years"))
    pref = F.col("drawn") * (F.pow(F.lit(1 + HURDLE), dbl("years")) - 1)
    return w.select("fund", "years", F.round(pref, 2).alias("pref"), F.round(F.greatest(F.col("dist") - F.col("drawn") - pref, F.lit(0.0)) * CARRY, 2).alias("carry"))


@query("g28_unit_allotment", "SELECT inv_id, round(sum(net)::DOUBLE / 12.5, 6) AS units FROM recv JOIN inv USING (inv_id) WHERE status <> 'P' GROUP BY 1")
def g28(t):
    per = t.recv.groupBy("inv_id").agg(F.sum("net").alias("net"))
    return per.join(t.inv.filter("status <> 'P'").select("inv_id"), "inv_id", "left_semi").select("inv_id", F.round(dbl("net") / 12.5, 6).alias("units"))


@query("g29_pro_rata", "WITH f AS (SELECT fund, company_id, sum(cost) AS cost FROM inv JOIN company USING (company_id) GROUP BY 1, 2) SELECT company_id, round(cost::DOUBLE / sum(cost) OVER (PARTITION BY fund)::DOUBLE * 1000000, 2) AS share FROM f")
def g29(t):
    f = t.inv.groupBy("company_id").agg(F.sum("cost").alias("cost")).join(t.company.select("company_id", "fund"), "company_id")
    whole = f.groupBy("fund").agg(F.sum("cost").alias("whole"))  # a join of sums: no fund's companies meet in one task
    return f.join(whole, "fund").select("company_id", F.round(dbl("cost") / dbl("whole") * 1000000, 2).alias("share"))


@query("g32_tranche_reconcile", "SELECT company_id, sum(cost)::DOUBLE AS total_invested, min(d) AS investment_date, arg_max(stage, (d, inv_id)) AS latest_round, count(*) AS tranches FROM inv GROUP BY 1")
def g32(t):
    return t.inv.groupBy("company_id").agg(total("cost", "total_invested"), F.min("d").alias("investment_date"), F.max_by("stage", F.struct("d", "inv_id")).alias("latest_round"), F.count("*").alias("tranches"))


@query("g33_synthetic_valuations", f"WITH {LATEST_VAL}, v AS (SELECT company_id, cash, fv FROM company LEFT JOIN lv ON holding_id = company_id) SELECT company_id, round(cash::DOUBLE * (SELECT sum(fv)::DOUBLE / sum(cash)::DOUBLE FROM v WHERE fv IS NOT NULL), 4) AS fair_value, 'cost_ratio' AS methodology FROM v WHERE fv IS NULL")
def g33(t):
    v = t.company.join(latest_valuation(t).select(F.col("holding_id").alias("company_id"), "fv"), "company_id", "left")
    k = v.filter("fv is not null").agg((F.sum("fv").cast("double") / F.sum("cash").cast("double")).alias("k"))
    return v.filter("fv is null").crossJoin(k).select("company_id", F.round(dbl("cash") * F.col("k"), 4).alias("fair_value"), F.lit("cost_ratio").alias("methodology"))  # one row


@query("g35_level1", "SELECT p_partkey AS part_id, round(p_retailprice * p_size * (1 - 0.1), 2) AS value FROM part")
def g35(t):
    return t.part.select(F.col("p_partkey").alias("part_id"), F.round(F.col("p_retailprice") * F.col("p_size") * F.lit(1 - 0.1), 2).alias("value"))


@query("g36_level2_multiples", "SELECT company_id, round((cash::DOUBLE * 3.5 + cash::DOUBLE * 0.25 * 12) / 2 * 0.15 * (1 - 0.2), 2) AS value FROM company")
def g36(t):
    """Mean of the values by revenue and by EBITDA multiple, times stake, less discount."""
    ev = (dbl("cash") * 3.5 + dbl("cash") * 0.25 * 12) / 2
    return t.company.select("company_id", F.round(ev * 0.15 * F.lit(1 - 0.2), 2).alias("value"))


@query("g37_level3_dcf", """SELECT company_id, round(list_sum(list_transform([10.0, 15.0, 20.0]::DOUBLE[], lambda x, i: (x + cash::DOUBLE / 1000) / pow(1.18::DOUBLE, i::DOUBLE))) + (20.0 + cash::DOUBLE / 1000) * 1.04 / 0.14 / pow(1.18::DOUBLE, 3.0), 4) AS value FROM company""")
def g37(t):
    flows = F.transform(F.array(*map(F.lit, (10.0, 15.0, 20.0))), lambda x: x + dbl("cash") / 1000)
    return t.company.select("company_id", F.round(dcf(flows, F.lit(0.18), F.lit(0.04)), 4).alias("value"))


@query("g38_pre_ipo", "SELECT company_id, round(cash::DOUBLE * 0.12 * 0.8, 2) AS value FROM company")
def g38(t):
    return t.company.select("company_id", F.round(dbl("cash") * 0.12 * 0.8, 2).alias("value"))


BVA = """bva AS (SELECT company_id, stage AS item, sum(cost) FILTER (year(d) = 1999) AS budget, sum(cost) FILTER (year(d) = 2000) AS actual FROM inv WHERE year(d) IN (1999, 2000) GROUP BY 1, 2)"""


def bva(t):
    of = lambda y: F.sum(F.when(F.year("d") == y, F.col("cost")))
    return t.inv.filter(F.year("d").isin(1999, 2000)).groupBy("company_id", F.col("stage").alias("item")).agg(of(1999).alias("budget"), of(2000).alias("actual"))


@query("g39_variance", f"WITH {BVA}, v AS (SELECT *, actual - budget AS variance FROM bva) SELECT company_id, item, variance::DOUBLE AS variance, round(variance::DOUBLE / nullif(abs(budget), 0)::DOUBLE * 100, 2) AS variance_pct, CASE WHEN item IN ('1-URGENT', '2-HIGH') THEN variance < 0 ELSE variance > 0 END AS is_favorable FROM v")
def g39(t):
    """Favourable is more for income, less for cost items; unknown where a side is missing."""
    v = bva(t).withColumn("variance", F.col("actual") - F.col("budget"))
    good = F.when(F.col("item").isin("1-URGENT", "2-HIGH"), F.col("variance") < 0).otherwise(F.col("variance") > 0)
    return v.select("company_id", "item", dbl("variance").alias("variance"), F.round(F.try_divide(dbl("variance"), F.nullif(dbl(F.abs("budget")), F.lit(0.0))) * 100, 2).alias("variance_pct"), good.alias("is_favorable"))


@query("g40_consolidation", f"WITH {BVA} SELECT fund, item, sum(budget)::DOUBLE AS budget, sum(actual)::DOUBLE AS actual, count(DISTINCT company_id) AS companies, round((sum(actual) - sum(budget))::DOUBLE / nullif(abs(sum(budget)), 0)::DOUBLE, 4) AS variance FROM bva JOIN company USING (company_id) GROUP BY 1, 2")
def g40(t):
    g = bva(t).join(t.company, "company_id").groupBy("fund", "item").agg(F.sum("budget").alias("b"), F.sum("actual").alias("a"), F.count("*").alias("companies"))
    return g.select("fund", "item", dbl("b").alias("budget"), dbl("a").alias("actual"), "companies", ratio(F.col("a") - F.col("b"), F.abs("b")).alias("variance"))


@query("g41_variance_anomalies", f"WITH {BVA}, v AS (SELECT company_id, item, abs(round((actual - budget)::DOUBLE / abs(budget)::DOUBLE * 100, 2)) AS pct FROM bva WHERE budget <> 0) SELECT company_id, item, CASE WHEN pct >= 50 THEN 'critical' WHEN pct >= 25 THEN 'high' ELSE 'medium' END AS severity FROM v WHERE pct >= 10")
def g41(t):
    v = bva(t).filter("budget <> 0").select("company_id", "item", F.abs(F.round(dbl(F.col("actual") - F.col("budget")) / dbl(F.abs("budget")) * 100, 2)).alias("pct"))
    return v.filter("pct >= 10").select("company_id", "item", F.when(F.col("pct") >= 50, "critical").when(F.col("pct") >= 25, "high").otherwise("medium").alias("severity"))


@query("g42_burn_runway", "WITH g AS (SELECT company_id, sum(cost) FILTER (stage = '1-URGENT') AS opex, sum(cost) FILTER (stage = '2-HIGH') AS revenue FROM inv GROUP BY 1) SELECT company_id, opex::DOUBLE AS gross_burn, greatest(opex - revenue, 0)::DOUBLE AS net_burn, round(cash::DOUBLE / nullif(opex, 0)::DOUBLE, 4) + 0.0::DOUBLE AS runway FROM g JOIN company USING (company_id)")
def g42(t):
    of = lambda s: F.sum(F.when(F.col("stage") == s, F.col("cost")))
    g = t.inv.groupBy("company_id").agg(of("1-URGENT").alias("o"), of("2-HIGH").alias("r")).join(t.company, "company_id")
    net = F.when((F.col("o") - F.col("r")).isNotNull(), F.greatest(F.col("o") - F.col("r"), F.lit(0))).otherwise(F.lit(0))
    return g.select("company_id", dbl("o").alias("gross_burn"), dbl(net).alias("net_burn"), ratio("cash", "o").alias("runway"))


@query("g43_exits_summary", "SELECT fund, count(*) AS exits, sum(inv.cost)::DOUBLE AS cost, sum(r.net)::DOUBLE AS proceeds, round(sum(r.net)::DOUBLE / sum(inv.cost)::DOUBLE, 4) AS dpi FROM recv r JOIN inv USING (inv_id) JOIN company USING (company_id) WHERE r.flag = 'R' GROUP BY 1")
def g43(t):
    """Cost counts once for each exit row, as the figure is defined."""
    per = t.recv.filter("flag = 'R'").groupBy("inv_id").agg(F.count("*").alias("k"), F.sum("net").alias("net"))
    g = per.join(t.inv, "inv_id").join(t.company, "company_id").groupBy("fund").agg(F.sum("k").alias("exits"), F.sum(F.col("cost") * F.col("k")).alias("c"), F.sum("net").alias("p"))
    return g.select("fund", "exits", dbl("c").alias("cost"), dbl("p").alias("proceeds"), ratio("p", "c").alias("dpi"))


@query("g45_quoted_split", "SELECT CASE WHEN segment = 'BUILDING' OR company_id % 5 = 1 THEN 'quoted' ELSE 'unquoted' END AS kind, count(*) AS n, sum(cash)::DOUBLE AS fv FROM company GROUP BY 1")
def g45(t):
    kind = F.when((F.col("segment") == "BUILDING") | (F.col("company_id") % 5 == 1), "quoted").otherwise("unquoted")
    return t.company.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), total("cash", "fv"))


@query("g46_kpi_matrix", """SELECT holding_id, max(v) FILTER (methodology = 'click')::DOUBLE AS click, max(v) FILTER (methodology = 'view')::DOUBLE AS view, max(v) FILTER (methodology = 'purchase')::DOUBLE AS purchase FROM
  (SELECT holding_id, methodology, arg_max(CASE WHEN abs(fair) < 1 THEN fair * 100 ELSE fair END, (ts, val_id)) AS v FROM val WHERE methodology IN ('click', 'view', 'purchase') GROUP BY 1, 2) GROUP BY 1""")
def g46(t):
    """The newest reading of each KPI; fractions become percent."""
    pct = F.when(F.abs("fair") < 1, F.col("fair") * 100).otherwise(F.col("fair"))
    kinds = ("click", "view", "purchase")
    newest = [dbl(F.max_by(F.when(F.col("methodology") == k, pct), F.when(F.col("methodology") == k, F.struct("ts", "val_id")))).alias(k) for k in kinds]
    return t.val.filter(F.col("methodology").isin(*kinds)).groupBy("holding_id").agg(*newest)


@query("g47_mean_holding_years", f"SELECT fund, round(sum(date_diff('day', d, DATE '{AS_OF}'))::DOUBLE / count(*)::DOUBLE / 365.25, 1) AS years FROM inv JOIN company USING (company_id) GROUP BY 1")
def g47(t):
    per = t.inv.groupBy("company_id").agg(F.sum(F.datediff(as_of(), "d")).alias("days"), F.count("*").alias("k")).join(t.company, "company_id")
    return per.groupBy("fund").agg(F.round(F.sum("days").cast("double") / F.sum("k").cast("double") / 365.25, 1).alias("years"))


@query("g48_kpi_ladder", """WITH k AS (SELECT company_id, sum(cost) FILTER (stage = '1-URGENT')::DOUBLE AS revenue, sum(cost) FILTER (stage = '2-HIGH')::DOUBLE AS cogs, sum(cost) FILTER (stage = '3-MEDIUM')::DOUBLE AS opex, sum(cost) FILTER (stage = '5-LOW')::DOUBLE AS mrr FROM inv GROUP BY 1),
  l AS (SELECT *, revenue - cogs AS gp, coalesce(mrr, revenue / 12) AS mrr2 FROM k) SELECT company_id, round(gp, 2) AS gross_profit, round(gp / nullif(revenue, 0) * 100, 2) AS gm_pct, round(gp - opex, 2) AS ebitda, round((gp - opex) / nullif(revenue, 0) * 100, 2) AS ebitda_pct, round(mrr2, 2) AS mrr, round(mrr2 * 12, 2) AS arr FROM l""")
def g48(t):
    """Later figures are derived from earlier ones, in this order; one that is given isn't derived."""
    of = lambda s: F.sum(F.when(F.col("stage") == s, F.col("cost"))).cast("double")
    k = t.inv.groupBy("company_id").agg(of("1-URGENT").alias("revenue"), of("2-HIGH").alias("cogs"), of("3-MEDIUM").alias("opex"), of("5-LOW").alias("mrr"))
    pct = lambda c: F.round(F.try_divide(F.col(c), F.nullif("revenue", F.lit(0.0))) * 100, 2)
    k = k.withColumn("gross_profit", F.col("revenue") - F.col("cogs")).withColumn("ebitda", F.col("gross_profit") - F.col("opex")).withColumn("mrr", F.coalesce("mrr", F.col("revenue") / 12))
    return k.select("company_id", F.round("gross_profit", 2).alias("gross_profit"), pct("gross_profit").alias("gm_pct"), F.round("ebitda", 2).alias("ebitda"), pct("ebitda").alias("ebitda_pct"), F.round("mrr", 2).alias("mrr"), F.round(F.col("mrr") * 12, 2).alias("arr"))


#: Units of a currency for one dollar.
RATES = {"USD": 1.0, "INR": 83.0, "EUR": 0.92, "MYR": 4.7}


@query("g50_fx_via_usd", "WITH r(cur, rate) AS (VALUES ('USD', 1.0::DOUBLE), ('INR', 83.0), ('EUR', 0.92), ('MYR', 4.7)), c AS (SELECT inv_id, cost::DOUBLE AS cost, ['USD', 'INR', 'EUR', 'MYR'][inv_id % 4 + 1] AS cur FROM inv) SELECT inv_id, cur, round(cost / rate * 83.0, 2) AS inr FROM c JOIN r USING (cur)")
def g50(t):
    cur = F.element_at(F.array(*map(F.lit, RATES)), (F.col("inv_id") % 4 + 1).cast("int"))
    rates = F.create_map(*[F.lit(x) for kv in RATES.items() for x in kv])
    rate = F.coalesce(F.try_element_at(rates, F.col("cur")), F.raise_error(F.concat(F.lit("unknown currency "), F.col("cur"))).cast("double"))
    return t.inv.select("inv_id", "cost", cur.alias("cur")).select("inv_id", "cur", F.round(dbl("cost") / rate * RATES["INR"], 2).alias("inr"))


@query("g51_cash_flow_statement", "SELECT year(d)::INT AS fy, CASE WHEN flag = 'R' THEN 'operating' WHEN flag = 'A' AND line = 'F' THEN 'investing' WHEN line = 'O' THEN 'financing' ELSE 'other' END AS activity, sum(gross - tax)::DOUBLE AS amount FROM recv GROUP BY 1, 2")
def g51(t):
    kind = F.when(F.col("flag") == "R", "operating").when((F.col("flag") == "A") & (F.col("line") == "F"), "investing").when(F.col("line") == "O", "financing").otherwise("other")
    return t.recv.groupBy(F.year("d").alias("fy"), kind.alias("activity")).agg(total(F.col("gross") - F.col("tax"), "amount"))


@query("g52_risk_score", """WITH s AS (SELECT holding_id, count(*) FILTER (methodology = 'error') AS errors, count(*) AS n, avg(fair::DOUBLE) AS mean FROM val GROUP BY 1), p AS (SELECT holding_id, CASE WHEN errors * 4 > n THEN 9 WHEN errors * 5 > n THEN 6 ELSE 2 END AS a, CASE WHEN n < 40 THEN 8 WHEN n < 65 THEN 5 ELSE 1 END AS b, CASE WHEN mean < 45 THEN 7 WHEN mean < 55 THEN 4 ELSE 1 END AS c FROM s)
  SELECT holding_id, round(least(greatest((a * 0.5::DOUBLE + b * 0.3::DOUBLE + c * 0.2::DOUBLE) * 10, 0), 100), 2) AS score, CASE WHEN (a * 0.5::DOUBLE + b * 0.3::DOUBLE + c * 0.2::DOUBLE) * 10 > 66 THEN 'high' WHEN (a * 0.5::DOUBLE + b * 0.3::DOUBLE + c * 0.2::DOUBLE) * 10 > 33 THEN 'medium' ELSE 'low' END AS tier FROM p""")
def g52(t):
    """Graded signals, weighed; times ten, clamped; tiers at 33 and 66."""
    s = t.val.groupBy("holding_id").agg(F.count_if(F.col("methodology") == "error").alias("errors"), F.count("*").alias("n"), F.avg(dbl("fair")).alias("mean"))
    a = F.when(F.col("errors") * 4 > F.col("n"), 9).when(F.col("errors") * 5 > F.col("n"), 6).otherwise(2)
    b = F.when(F.col("n") < 40, 8).when(F.col("n") < 65, 5).otherwise(1)
    c = F.when(F.col("mean") < 45, 7).when(F.col("mean") < 55, 4).otherwise(1)
    s = s.withColumn("raw", (a * F.lit(0.5) + b * F.lit(0.3) + c * F.lit(0.2)) * 10)
    return s.select("holding_id", F.round(F.least(F.greatest("raw", F.lit(0.0)), F.lit(100.0)), 2).alias("score"), F.when(F.col("raw") > 66, "high").when(F.col("raw") > 33, "medium").otherwise("low").alias("tier"))


@query("g55_exit_signal", f"WITH a AS (SELECT company_id, date_diff('day', min(d), DATE '{AS_OF}') / 365.25 AS age, count(*) AS n FROM inv GROUP BY 1), s AS (SELECT company_id, least(greatest(50 + CASE WHEN age > 5 THEN 15 WHEN age > 3 THEN 8 ELSE -5 END + CASE WHEN n >= 10 THEN 10 ELSE -10 END, 0), 100) AS score FROM a) SELECT company_id, score::INT AS score, CASE WHEN score >= 70 THEN 'now' WHEN score >= 55 THEN 'soon' WHEN score >= 40 THEN 'watch' ELSE 'hold' END AS timing FROM s")
def g55(t):
    a = t.inv.groupBy("company_id").agg((F.datediff(as_of(), F.min("d")) / 365.25).alias("age"), F.count("*").alias("n"))
    score = 50 + F.when(F.col("age") > 5, 15).when(F.col("age") > 3, 8).otherwise(-5) + F.when(F.col("n") >= 10, 10).otherwise(-10)
    s = a.select("company_id", F.least(F.greatest(score, F.lit(0)), F.lit(100)).alias("score"))
    return s.select("company_id", "score", F.when(F.col("score") >= 70, "now").when(F.col("score") >= 55, "soon").when(F.col("score") >= 40, "watch").otherwise("hold").alias("timing"))


@query("g57_forecast", "SELECT company_id, m::INT AS m, round(cash * 0.15 * (1 + 0.015 * m), 2)::DOUBLE AS forecast FROM company, (SELECT unnest([1, 2, 3, 4, 5, 6]) m)")
def g57(t):
    return t.company.select("company_id", "cash", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("m")).select("company_id", "m", F.expr("cast(round(cash * 0.15 * (1 + 0.015 * m), 2) as double)").alias("forecast"))


TAX = "x AS (SELECT inv_id, d, cost AS gross, round(cost * 0.1, 2) AS tax FROM inv), y AS (SELECT *, round(tax * 0.15, 2) AS surcharge FROM x), tds AS (SELECT *, round((tax + surcharge) * 0.04, 2) AS cess, CASE WHEN month(d) >= 4 THEN year(d) + 1 ELSE year(d) END AS fy, 'Q' || ((month(d) + 8) % 12 // 3 + 1) AS q FROM y)"


def tds(t):
    """Tax on the amount, surcharge on the tax, cess on both; fiscal years run from April and are named by their end."""
    x = t.inv.select("inv_id", "d", F.col("cost").alias("gross")).withColumn("tax", F.expr("round(gross * 0.1, 2)")).withColumn("surcharge", F.expr("round(tax * 0.15, 2)"))
    x = x.withColumn("cess", F.expr("round((tax + surcharge) * 0.04, 2)"))
    return x.withColumn("fy", F.year(F.add_months("d", 9))).withColumn("q", F.concat(F.lit("Q"), F.quarter(F.add_months("d", -3)).cast("string")))


@query("g58_tds", f"WITH {TAX} SELECT inv_id, 'FY' || fy AS fy, q AS quarter, (tax + surcharge + cess)::DOUBLE AS total, (gross - tax - surcharge - cess)::DOUBLE AS net FROM tds")
def g58(t):
    due = F.col("tax") + F.col("surcharge") + F.col("cess")
    return tds(t).select("inv_id", F.concat(F.lit("FY"), F.col("fy").cast("string")).alias("fy"), F.col("q").alias("quarter"), dbl(due).alias("total"), dbl(F.col("gross") - due).alias("net"))


@query("g59_form_26q", f"WITH {TAX} SELECT 'FY' || fy AS fy, q AS quarter, count(*) AS n, sum(gross::DECIMAL(18,2))::DOUBLE AS paid, sum(tax::DECIMAL(18,2))::DOUBLE AS tax FROM tds GROUP BY fy, q")
def g59(t):
    return tds(t).groupBy(F.concat(F.lit("FY"), F.col("fy").cast("string")).alias("fy"), F.col("q").alias("quarter")).agg(F.count("*").alias("n"), total(F.col("gross").cast("decimal(18,2)"), "paid"), total(F.col("tax").cast("decimal(18,2)"), "tax"))


@query("g61_carry_identity", f"WITH {BASE} SELECT fund, CASE WHEN realised IS NOT NULL THEN greatest(distributed - realised, 0)::DOUBLE END AS net FROM fb")
def g61(t):
    return base(t).select("fund", F.when(F.col("realised").isNotNull() & F.col("distributed").isNotNull(), dbl(F.greatest(F.col("distributed") - F.col("realised"), F.lit(0)))).alias("net"))
