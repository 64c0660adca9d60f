"""The fund's figures as one frame: totals, multiples, rates and net asset value with every rung of their ladders (inventory G10 to G22).

A scheme is a nation. What a workbook states itself, the register of investors says, or nobody knows, is made from the scheme's
number k, so that each rung decides for some schemes: see FACTS.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.money import xirr
from ..registry import query
from ..sources.tables import AS_OF, dbl
from .finance import irr_sql
from .relational import LATEST_VAL, latest_valuation

CARRY, FEE, HOLDBACK = 0.2, 0.02, 0.1

FACTS = f"""{LATEST_VAL},
co AS (SELECT company_id, sector AS scheme, n_nationkey AS k, cash FROM company JOIN nation ON sector = n_name),
i1 AS (SELECT scheme, k, sum(cost)::DOUBLE AS cost FROM inv JOIN co USING (company_id) GROUP BY 1, 2),
r1 AS (SELECT scheme, sum(CASE WHEN flag = 'A' THEN coalesce(CASE WHEN n <> 1 THEN net END, gross) END)::DOUBLE AS ledger, sum(CASE WHEN flag = 'R' THEN net END)::DOUBLE AS exit_net, sum(CASE WHEN flag = 'R' THEN gross END)::DOUBLE AS exit_gross FROM recv JOIN inv USING (inv_id) JOIN co USING (company_id) GROUP BY 1),
c1 AS (SELECT scheme, sum(cash)::DOUBLE AS cash, sum(lv.fair)::DOUBLE * 5000 AS fair, sum(CASE WHEN company_id % 3 <> 0 THEN lv.fv END)::DOUBLE * 5000 AS active FROM co LEFT JOIN lv ON holding_id = company_id GROUP BY 1),
facts AS (SELECT i1.scheme, i1.k, cost AS invested, CASE WHEN i1.k % 5 <> 4 THEN cost END AS calls, cost * CASE WHEN i1.k % 3 = 0 THEN 2.5 ELSE 1.02 END AS register_called, cost * 1.3 AS committed,
  CASE WHEN i1.k % 7 <> 2 THEN ledger ELSE 0 END AS ledger, CASE WHEN i1.k % 6 = 1 THEN ledger * 1.1 END AS trusted_distributed, cost * 0.3 AS register_distributed,
  CASE WHEN i1.k % 4 <> 3 THEN exit_net ELSE 0 END AS exit_net, exit_gross, fair AS portfolio_fv, CASE WHEN i1.k % 5 <> 1 THEN active END AS active_fv, CASE WHEN i1.k % 8 <> 5 THEN cost * CASE WHEN i1.k % 8 = 6 THEN 6.0 ELSE 1.2 END END AS stated_nav,
  i1.k % 2 = 0 AS european, CASE WHEN i1.k % 4 = 0 THEN {HOLDBACK}::DOUBLE END AS holdback, CASE WHEN i1.k % 3 = 1 THEN cost * 0.005 ELSE 0 END AS paid_carry, CASE WHEN i1.k % 5 = 3 THEN 1.5::DOUBLE END AS stated_tvpi, CASE WHEN i1.k % 6 = 0 THEN 12.0::DOUBLE END AS stated_irr,
  cash, CASE WHEN i1.k % 6 <> 5 THEN cash * 0.1 END AS receivables, CASE WHEN i1.k % 10 <> 7 THEN cash * 0.05 END AS liabilities, CASE WHEN i1.k % 9 <> 0 THEN cost / 100000 END AS units, CASE WHEN i1.k % 18 = 0 THEN 1500000.0::DOUBLE WHEN i1.k % 9 = 0 THEN 95.0::DOUBLE END AS stated_unit
  FROM i1 JOIN r1 USING (scheme) JOIN c1 USING (scheme))"""


def owners(t):
    """company_id, scheme, k and cash."""
    return t.company.join(F.broadcast(t.nation.select(F.col("n_name").alias("sector"), F.col("n_nationkey").alias("k"))), "sector").select("company_id", F.col("sector").alias("scheme"), "k", "cash")  # 25 nations


def facts(t):
    """One row a scheme. Receipts are summed to investments, investments to companies, companies to schemes."""
    when = lambda cond, c: F.sum(F.when(cond, c))
    per = t.recv.groupBy("inv_id").agg(
        when(F.col("flag") == "A", F.coalesce(F.when(F.col("n") != 1, F.col("net")), F.col("gross"))).alias("ledger"), when(F.col("flag") == "R", F.col("net")).alias("exit_net"), when(F.col("flag") == "R", F.col("gross")).alias("exit_gross")
    )
    sums = ("cost", "ledger", "exit_net", "exit_gross")
    per = t.inv.join(per, "inv_id", "left").groupBy("company_id").agg(*[F.sum(c).alias(c) for c in sums])
    marks = latest_valuation(t).select(F.col("holding_id").alias("company_id"), "fv", "fair")
    rows = owners(t).join(per, "company_id", "left").join(marks, "company_id", "left")
    g = rows.groupBy("scheme", "k").agg(*[F.sum(c).cast("double").alias(c) for c in (*sums, "cash")], (dbl(F.sum("fair")) * 5000).alias("fair"), (dbl(when(F.col("company_id") % 3 != 0, F.col("fv"))) * 5000).alias("active")).filter("cost is not null")
    k, c = lambda m: F.col("k") % m, F.col
    return g.select(
        "scheme", "k", c("cost").alias("invested"), F.when(k(5) != 4, c("cost")).alias("calls"), (c("cost") * F.when(k(3) == 0, 2.5).otherwise(1.02)).alias("register_called"), (c("cost") * 1.3).alias("committed"),
        F.when(k(7) != 2, c("ledger")).otherwise(0.0).alias("ledger"), F.when(k(6) == 1, c("ledger") * 1.1).alias("trusted_distributed"), (c("cost") * 0.3).alias("register_distributed"),
        F.when(k(4) != 3, c("exit_net")).otherwise(0.0).alias("exit_net"), "exit_gross", c("fair").alias("portfolio_fv"), F.when(k(5) != 1, c("active")).alias("active_fv"), F.when(k(8) != 5, c("cost") * F.when(k(8) == 6, 6.0).otherwise(1.2)).alias("stated_nav"),
        (k(2) == 0).alias("european"), F.when(k(4) == 0, F.lit(HOLDBACK)).alias("holdback"), F.when(k(3) == 1, c("cost") * 0.005).otherwise(0.0).alias("paid_carry"), F.when(k(5) == 3, 1.5).alias("stated_tvpi"), F.when(k(6) == 0, 12.0).alias("stated_irr"),
        "cash", F.when(k(6) != 5, c("cash") * 0.1).alias("receivables"), F.when(k(10) != 7, c("cash") * 0.05).alias("liabilities"), F.when(k(9) != 0, c("cost") / 100000).alias("units"), F.when(k(18) == 0, 1500000.0).when(k(9) == 0, 95.0).alias("stated_unit"),
    )


FRAME = f"""{FACTS},
f1 AS (SELECT *, CASE WHEN register_called > 2 * coalesce(calls, 0) THEN register_called ELSE calls END AS called, CASE WHEN trusted_distributed IS NOT NULL THEN trusted_distributed WHEN ledger <> 0 THEN ledger ELSE register_distributed END AS distributed,
  CASE WHEN coalesce(exit_net, 0) <> 0 THEN exit_net ELSE coalesce(exit_gross, 0) END AS realised FROM facts),
f2 AS (SELECT *, CASE WHEN active_fv IS NOT NULL THEN active_fv WHEN stated_nav <= 5 * invested THEN stated_nav END AS residual FROM f1),
f3 AS (SELECT *, CASE WHEN european THEN greatest(0, realised + coalesce(residual, 0) - called) END AS carry_base FROM f2),
f4 AS (SELECT *, {CARRY} * carry_base AS gross_carry FROM f3),
f5 AS (SELECT *, gross_carry * (1 - coalesce(holdback, 0)) AS net_carry, residual - greatest(0, coalesce(gross_carry, 0) - paid_carry) AS residual_after_carry FROM f4),
f6 AS (SELECT *, CASE WHEN distributed > 0 AND residual IS NOT NULL THEN (distributed + residual_after_carry) / called WHEN stated_nav IS NOT NULL THEN stated_nav / called ELSE stated_tvpi END AS tvpi,
  CASE WHEN distributed > 0 AND residual IS NOT NULL THEN 'distributions' WHEN stated_nav IS NOT NULL THEN 'nav' WHEN stated_tvpi IS NOT NULL THEN 'stated' ELSE 'unavailable' END AS tvpi_method,
  realised + residual + cash + receivables - invested * {FEE} - coalesce(gross_carry, 0) - liabilities AS built FROM f5),
f7 AS (SELECT *, coalesce(built, stated_nav) AS nav, CASE WHEN built IS NOT NULL THEN 'built' WHEN stated_nav IS NOT NULL THEN 'stated' ELSE 'unavailable' END AS nav_method FROM f6)"""


def frame(t):
    """facts with each figure of the fund in the order in which later ones need earlier ones."""
    c, zero = F.col, F.lit(0.0)
    f = facts(t)
    f = f.withColumn("called", F.when(c("register_called") > 2 * F.coalesce("calls", zero), c("register_called")).otherwise(c("calls")))
    f = f.withColumn("distributed", F.coalesce("trusted_distributed", F.nullif(c("ledger"), zero), "register_distributed"))
    f = f.withColumn("realised", F.coalesce(F.nullif(c("exit_net"), zero), "exit_gross", zero))  # of the sums, not row by row
    f = f.withColumn("residual", F.coalesce("active_fv", F.when(c("stated_nav") <= 5 * c("invested"), c("stated_nav"))))
    f = f.withColumn("carry_base", F.when(c("european") & c("called").isNotNull(), F.greatest(zero, c("realised") + F.coalesce("residual", zero) - c("called"))))
    f = f.withColumn("gross_carry", c("carry_base") * CARRY).withColumn("net_carry", c("gross_carry") * (1 - F.coalesce("holdback", zero)))
    f = f.withColumn("residual_after_carry", c("residual") - F.greatest(zero, F.coalesce("gross_carry", zero) - c("paid_carry")))
    rungs = [("distributions", (c("distributed") > 0) & c("residual").isNotNull(), (c("distributed") + c("residual_after_carry")) / c("called")), ("nav", c("stated_nav").isNotNull(), c("stated_nav") / c("called")), ("stated", c("stated_tvpi").isNotNull(), c("stated_tvpi"))]
    f = f.withColumn("tvpi", ladder([(x, y) for _, x, y in rungs], F.lit(None))).withColumn("tvpi_method", ladder([(x, F.lit(m)) for m, x, _ in rungs], F.lit("unavailable")))
    f = f.withColumn("built", c("realised") + c("residual") + c("cash") + c("receivables") - c("invested") * FEE - F.coalesce("gross_carry", zero) - c("liabilities"))
    return f.withColumn("nav", F.coalesce("built", "stated_nav")).withColumn("nav_method", ladder([(c("built").isNotNull(), F.lit("built")), (c("stated_nav").isNotNull(), F.lit("stated"))], F.lit("unavailable")))


def ladder(rungs: list[tuple[Column, Column]], last: Column) -> Column:
    """The value of the first rung whose condition holds."""
    out = last
    for holds, value in reversed(rungs):
        out = F.when(holds, value).otherwise(out)
    return out


@query("g10_fund_frame", f"""WITH {FRAME} SELECT scheme, round(called, 2) AS called, round(distributed, 2) AS distributed, round(realised, 2) AS realised, round(portfolio_fv, 2) AS portfolio_fv, round(active_fv, 2) AS active_fv, round(residual, 2) AS residual, round((realised + residual) / invested, 4) AS moic, round(distributed / called, 4) AS dpi,
  round(residual_after_carry / called, 4) AS rvpi, round(tvpi, 4) AS tvpi, tvpi_method, round(gross_carry, 2) AS gross_carry, round(net_carry, 2) AS net_carry, round(nav, 2) AS nav, nav_method, round(CASE WHEN units IS NOT NULL THEN nav * 100 / units WHEN stated_unit > 10000 THEN stated_unit / 100000 ELSE stated_unit END, 4) AS nav_per_unit,
  round(greatest(0, committed - called), 2) AS uncalled, round(realised, 2) AS realised_value, round(active_fv, 2) AS unrealised_value FROM f7""")
def g10(t):
    """All figures of a scheme from one pass: G11 to G18 and G20 to G22. What a ladder can't tell is null."""
    c = F.col
    unit = F.when(c("units").isNotNull(), c("nav") * 100 / c("units")).when(c("stated_unit") > 10000, c("stated_unit") / 100000).otherwise(c("stated_unit"))
    money = ("called", "distributed", "realised", "portfolio_fv", "active_fv", "residual", "gross_carry", "net_carry", "nav")
    return frame(t).select(
        "scheme", *[F.round(m, 2).alias(m) for m in money], F.round((c("realised") + c("residual")) / c("invested"), 4).alias("moic"), F.round(c("distributed") / c("called"), 4).alias("dpi"), F.round(c("residual_after_carry") / c("called"), 4).alias("rvpi"),
        F.round("tvpi", 4).alias("tvpi"), "tvpi_method", "nav_method", F.round(unit, 4).alias("nav_per_unit"), F.when(c("called").isNotNull(), F.round(F.greatest(F.lit(0.0), c("committed") - c("called")), 2)).otherwise(0.0).alias("uncalled"), F.round("realised", 2).alias("realised_value"), F.round("active_fv", 2).alias("unrealised_value"),
    )


@query("g19_net_irr_ladder", f"""WITH RECURSIVE {FRAME}, fl AS (SELECT scheme, d, -sum(cost)::DOUBLE AS a FROM inv JOIN co USING (company_id) WHERE k % 5 <> 4 GROUP BY 1, 2 UNION ALL SELECT scheme, r.d, sum(r.net)::DOUBLE FROM recv r JOIN inv USING (inv_id) JOIN co USING (company_id) WHERE flag = 'A' AND k % 7 <> 2 GROUP BY 1, 2
  UNION ALL SELECT scheme, DATE '{AS_OF}', residual FROM f7 WHERE residual > 0), {irr_sql('fl', 'scheme')},
  j AS (SELECT f7.*, CASE WHEN calls > 0 AND ledger > 0 AND residual > 0 AND called >= 0.5 * invested AND abs(irr) <= 500 THEN irr END AS own FROM f7 LEFT JOIN irr USING (scheme))
  SELECT scheme, coalesce(own, stated_irr) AS net_irr, CASE WHEN own IS NOT NULL THEN 'computed' WHEN stated_irr IS NOT NULL THEN 'stated' ELSE 'unavailable' END AS method, abs(own - stated_irr) <= 1.0 AS agree FROM j""")
def g19(t):
    """Of a scheme's calls, distributions and residual, if there are all three and half of what is invested was called; else what is stated."""
    who = owners(t).select("company_id", "scheme", "k")
    calls = t.inv.groupBy("company_id", "d").agg(F.sum("cost").alias("a")).join(who.filter("k % 5 <> 4"), "company_id").groupBy("scheme", "d").agg((-F.sum("a")).cast("double").alias("a"))
    got = t.recv.filter("flag = 'A'").groupBy("inv_id", "d").agg(F.sum("net").alias("a")).join(t.inv.select("inv_id", "company_id"), "inv_id").join(who.filter("k % 7 <> 2"), "company_id").groupBy("scheme", "d").agg(F.sum("a").cast("double").alias("a"))
    figures = frame(t)
    left = figures.filter("residual > 0").select("scheme", F.lit(AS_OF).cast("date").alias("d"), F.col("residual").alias("a"))
    rates = calls.unionByName(got).unionByName(left).groupBy("scheme").agg(F.collect_list(F.struct("d", "a")).alias("f"))  # one flow a day and kind
    j = figures.join(rates.select("scheme", xirr(F.col("f")).alias("irr")), "scheme", "left")
    able = (F.col("calls") > 0) & (F.col("ledger") > 0) & (F.col("residual") > 0) & (F.col("called") >= 0.5 * F.col("invested")) & (F.abs("irr") <= 500)
    j = j.withColumn("own", F.when(able, F.col("irr")))
    method = ladder([(F.col("own").isNotNull(), F.lit("computed")), (F.col("stated_irr").isNotNull(), F.lit("stated"))], F.lit("unavailable"))
    return j.select("scheme", F.coalesce("own", "stated_irr").alias("net_irr"), method.alias("method"), (F.abs(F.col("own") - F.col("stated_irr")) <= 1.0).alias("agree"))


CHECKS = ("tvpi_is_dpi_plus_rvpi", "dpi_is_distributed_over_called", "moic_is_value_over_invested", "called_by_rows", "committed_by_rows", "net_carry_is_gross_less_holdback", "invested_by_rows", "fair_value_by_rows")
STATED = f"""{FRAME}, by_rows AS (SELECT scheme, sum(cost)::DOUBLE AS row_cost, sum(c.cash)::DOUBLE AS row_cash FROM inv JOIN (SELECT company_id, scheme, 0 AS cash FROM co) c USING (company_id) GROUP BY 1),
marks AS (SELECT scheme, sum(fair)::DOUBLE * 5000 AS row_fair FROM co JOIN lv ON holding_id = company_id GROUP BY 1),
st AS (SELECT f7.*, row_cost, row_fair, round(distributed / called, 4) * CASE WHEN k % 5 = 2 THEN 1.1 ELSE 1 END AS s_dpi, round(residual_after_carry / called, 4) AS s_rvpi, round(tvpi, 4) AS s_tvpi, round((realised + residual) / invested, 4) + CASE WHEN k % 4 = 1 THEN 0.5 ELSE 0 END AS s_moic, portfolio_fv * CASE WHEN k % 3 = 2 THEN 1.05 ELSE 1 END AS s_fv FROM f7 JOIN by_rows USING (scheme) LEFT JOIN marks USING (scheme))"""


@query("j08_eight_identities", f"""WITH {STATED}, u AS (
  SELECT scheme, '{CHECKS[0]}' AS identity, s_tvpi AS lhs, s_dpi + s_rvpi AS rhs, 0.02 AS tol FROM st UNION ALL SELECT scheme, '{CHECKS[1]}', s_dpi, distributed / called, 0.01 FROM st UNION ALL SELECT scheme, '{CHECKS[2]}', s_moic, (realised + residual) / invested, 0.05 FROM st
  UNION ALL SELECT scheme, '{CHECKS[3]}', called, row_cost, row_cost * 0.02 FROM st UNION ALL SELECT scheme, '{CHECKS[4]}', committed, row_cost * 1.3, row_cost * 0.01 FROM st UNION ALL SELECT scheme, '{CHECKS[5]}', net_carry, gross_carry - gross_carry * coalesce(holdback, 0), 0.5 FROM st
  UNION ALL SELECT scheme, '{CHECKS[6]}', invested, row_cost, 0.5 FROM st UNION ALL SELECT scheme, '{CHECKS[7]}', s_fv, row_fair, row_fair * 0.01 FROM st)
  SELECT scheme, identity, round(lhs, 4) AS lhs, round(rhs, 4) AS rhs, abs(lhs - rhs) <= tol AS ok FROM u""")
def j08(t):
    """What is stated of a scheme against what it should be, one row a check; not decided where a side is unknown. Some schemes state wrong figures on purpose."""
    rows = t.inv.groupBy("company_id").agg(F.sum("cost").alias("cost")).join(owners(t), "company_id").groupBy("scheme").agg(dbl(F.sum("cost")).alias("row_cost"))
    fair = latest_valuation(t).select(F.col("holding_id").alias("company_id"), "fair").join(owners(t), "company_id").groupBy("scheme").agg((dbl(F.sum("fair")) * 5000).alias("row_fair"))
    st = frame(t).join(rows, "scheme").join(fair, "scheme", "left")
    c, k = F.col, lambda m, r, x, y: F.when(F.col("k") % m == r, x).otherwise(y)
    s_dpi, s_moic = F.round(c("distributed") / c("called"), 4) * k(5, 2, 1.1, 1.0), F.round((c("realised") + c("residual")) / c("invested"), 4) + k(4, 1, 0.5, 0.0)
    sides = [
        (F.round("tvpi", 4), s_dpi + F.round(c("residual_after_carry") / c("called"), 4), F.lit(0.02)), (s_dpi, c("distributed") / c("called"), F.lit(0.01)), (s_moic, (c("realised") + c("residual")) / c("invested"), F.lit(0.05)),
        (c("called"), c("row_cost"), c("row_cost") * 0.02), (c("committed"), c("row_cost") * 1.3, c("row_cost") * 0.01), (c("net_carry"), c("gross_carry") - c("gross_carry") * F.coalesce("holdback", F.lit(0.0)), F.lit(0.5)),
        (c("invested"), c("row_cost"), F.lit(0.5)), (c("portfolio_fv") * k(3, 2, 1.05, 1.0), c("row_fair"), c("row_fair") * 0.01),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("identity"), lhs.alias("lhs"), rhs.alias("rhs"), (F.abs(lhs - rhs) <= tol).alias("ok")) for name, (lhs, rhs, tol) in zip(CHECKS, sides, strict=True)]))
    return st.select("scheme", each.alias("x")).select("scheme", "x.identity", F.round("x.lhs", 4).alias("lhs"), F.round("x.rhs", 4).alias("rhs"), "x.ok")
