"""Calculators with all their rungs (inventory G04, G05, G08, G24, G25, G29, G32, G35, G36, G48, G51, G55, G57, K01, K02, K08, K09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import AS_OF, dbl
from .fundframe import FACTS, FRAME, facts, frame, ladder, owners
from .portfolio import FEATURES, PL, features, mis, yearly
from .relational import LATEST_VAL, latest_valuation

VALUED_AT = "2024-01-20"
OLDEST = f"DATE '{AS_OF}'"


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def first_of(*rungs: tuple[Column, Column, str]) -> list[Column]:
    """The value of the first rung that holds, and its name, 'none' if none does."""
    return [ladder([(c, v) for c, v, _ in rungs], F.lit(None)), ladder([(c, F.lit(n)) for c, _, n in rungs], F.lit("none"))]


MARKUP = f"""{FACTS}, nv AS (SELECT scheme, d, sum(fair)::DOUBLE * 5000 AS at_fair FROM val JOIN co ON company_id = holding_id GROUP BY 1, 2), mk AS (SELECT scheme, invested, arg_max(at_fair, d) FILTER (d <= DATE '{VALUED_AT}') / invested AS markup FROM facts LEFT JOIN nv USING (scheme) GROUP BY 1, 2)"""


@query("g04_markup_as_of", f"WITH {MARKUP} SELECT scheme, round(coalesce(markup, 1.0), 6) AS markup FROM mk")
def g04(t):
    """Investments at fair value of the newest net asset value up to the day, over what was invested; 1 where there is none."""
    return markups(t).select("scheme", F.round("markup", 6).alias("markup"))


def markups(t) -> DataFrame:
    nv = t.val.filter(F.col("d") <= day(VALUED_AT)).groupBy(F.col("holding_id").alias("company_id"), "d").agg(F.sum("fair").alias("fair")).join(owners(t).select("company_id", "scheme"), "company_id")
    nv = nv.groupBy("scheme", "d").agg((dbl(F.sum("fair")) * 5000).alias("at_fair")).groupBy("scheme").agg(F.max_by("at_fair", "d").alias("at_fair"))
    return facts(t).join(nv, "scheme", "left").select("scheme", F.coalesce(F.col("at_fair") / F.col("invested"), F.lit(1.0)).alias("markup"))


@query("g05_fv_ladder", f"""WITH {MARKUP}, r AS (SELECT inv_id, max(CASE WHEN n = 1 THEN gross END)::DOUBLE * 10 AS post_money, max(CASE WHEN n = 2 THEN qty END) AS stake FROM recv GROUP BY 1), x AS (SELECT i.inv_id, CASE WHEN i.inv_id % 3 = 0 THEN lv.fv::DOUBLE END AS marked, post_money, CASE WHEN i.inv_id % 2 = 0 THEN stake / 100 ELSE stake END AS stake, i.cost::DOUBLE AS cost, coalesce(mk.markup, 1.0) AS markup FROM inv i JOIN co USING (company_id) JOIN mk USING (scheme) LEFT JOIN lv ON holding_id = company_id LEFT JOIN r USING (inv_id))
  SELECT inv_id, round(CASE WHEN marked IS NOT NULL THEN marked WHEN post_money > 0 AND stake > 0 THEN post_money * CASE WHEN stake > 1 THEN stake / 100 ELSE stake END * markup ELSE cost * markup END, 2) AS fv, CASE WHEN marked IS NOT NULL THEN 'valuation' WHEN post_money > 0 AND stake > 0 THEN 'round' ELSE 'cost' END AS rung FROM x""")
def g05(t):
    """Newest valuation; else the round's price times the stake (over 1: percent) times the markup; else cost times the markup."""
    c = F.col
    r = t.recv.groupBy("inv_id").agg((dbl(F.max(F.when(c("n") == 1, c("gross")))) * 10).alias("post_money"), F.max(F.when(c("n") == 2, c("qty"))).alias("stake"))
    lv = latest_valuation(t).select(c("holding_id").alias("company_id"), dbl("fv").alias("fv"))
    x = t.inv.join(owners(t).select("company_id", "scheme"), "company_id").join(F.broadcast(markups(t)), "scheme").join(lv, "company_id", "left").join(r, "inv_id", "left")  # one row a scheme is broadcast
    stake = F.when(c("inv_id") % 2 == 0, c("stake") / 100).otherwise(c("stake"))
    share = F.when(stake > 1, stake / 100).otherwise(stake)
    marked = F.when(c("inv_id") % 3 == 0, c("fv"))
    fv, rung = first_of((marked.isNotNull(), marked, "valuation"), ((c("post_money") > 0) & (stake > 0), c("post_money") * share * c("markup"), "round"), (F.lit(True), dbl("cost") * c("markup"), "cost"))
    return x.select("inv_id", F.round(fv, 2).alias("fv"), rung.alias("rung"))


WATERFALL = f"""{FRAME}, cl AS (SELECT scheme, min(d) AS closed FROM inv JOIN co USING (company_id) GROUP BY 1),
a AS (SELECT f7.*, closed, CASE WHEN k % 4 = 1 AND DATE '2001-06-30' > closed + 183 THEN DATE '2001-06-30' WHEN k % 4 = 2 AND DATE '1995-02-01' > closed + 183 THEN DATE '1995-02-01' WHEN k % 3 = 0 AND DATE '2001-09-30' > closed + 183 THEN DATE '2001-09-30' ELSE {OLDEST} END AS as_of,
  CASE WHEN k % 3 = 0 AND abs(register_called - coalesce(calls, 0)) > 1 THEN register_called ELSE coalesce(calls, 0) END AS drawn, coalesce(trusted_distributed, nullif(ledger, 0), nullif(realised, 0), register_distributed) AS paid, CASE WHEN k % 2 = 0 THEN 0.08 ELSE 0.1 END AS hurdle FROM f7 JOIN cl USING (scheme)),
p AS (SELECT scheme, sum(i.cost::DOUBLE * (pow(1 + hurdle::DOUBLE, greatest(0, date_diff('day', i.d, as_of)) / 365.25::DOUBLE) - 1)) AS pref FROM inv i JOIN co USING (company_id) JOIN a USING (scheme) GROUP BY 1),
w AS (SELECT a.*, pref, least(drawn, paid) AS roc, greatest(0, paid + coalesce(residual, 0) - drawn) AS base FROM a JOIN p USING (scheme)), x AS (SELECT *, least(pref * 0.2 / 0.8, greatest(0, paid - roc - pref)) AS catch_up, 0.2 * base AS gross FROM w), y AS (SELECT *, greatest(0, paid - roc - pref - catch_up) AS rest FROM x), z AS (SELECT *, greatest(0, catch_up + 0.2 * rest - gross) AS clawback FROM y)"""


@query("g08_waterfall_ladders", f"WITH {WATERFALL} SELECT scheme, as_of, round(drawn, 2) AS drawn, round(paid, 2) AS paid, round(roc, 2) AS roc, round(pref, 2) AS pref, round(base, 2) AS carry_base_all, round(catch_up, 2) AS catch_up, round(gross, 2) AS gross, round(clawback, 2) AS clawback, round(gross - clawback, 2) AS net, round((gross - clawback) * holdback, 2) AS held_back FROM z")
def g08(t):
    """The European waterfall with its ladders: the day it is struck at, a stored total that replaces the sum of calls, and what was distributed."""
    c, zero = F.col, F.lit(0.0)
    closed = t.inv.groupBy("company_id").agg(F.min("d").alias("d")).join(owners(t).select("company_id", "scheme"), "company_id").groupBy("scheme").agg(F.min("d").alias("closed"))
    a = frame(t).join(closed, "scheme")
    late = lambda d: day(d) > F.date_add("closed", 183)
    as_of = ladder([((c("k") % 4 == 1) & late("2001-06-30"), day("2001-06-30")), ((c("k") % 4 == 2) & late("1995-02-01"), day("1995-02-01")), ((c("k") % 3 == 0) & late("2001-09-30"), day("2001-09-30"))], day(AS_OF))
    calls = F.coalesce("calls", zero)
    a = a.withColumn("as_of", as_of).withColumn("drawn", F.when((c("k") % 3 == 0) & (F.abs(c("register_called") - calls) > 1), c("register_called")).otherwise(calls))
    a = a.withColumn("paid", F.coalesce("trusted_distributed", F.nullif(c("ledger"), zero), F.nullif(c("realised"), zero), "register_distributed")).withColumn("hurdle", F.when(c("k") % 2 == 0, 0.08).otherwise(0.1))
    by_day = t.inv.groupBy("company_id", "d").agg(F.sum("cost").alias("cost")).join(owners(t).select("company_id", "scheme"), "company_id").groupBy("scheme", "d").agg(dbl(F.sum("cost")).alias("cost"))
    pref = by_day.join(F.broadcast(a.select("scheme", "as_of", "hurdle")), "scheme").groupBy("scheme").agg(F.sum(c("cost") * (F.pow(1 + c("hurdle"), F.greatest(F.lit(0), F.datediff("as_of", "d")) / 365.25) - 1)).alias("pref"))  # one row a scheme
    w = a.join(pref, "scheme").withColumn("roc", F.least("drawn", "paid")).withColumn("base", F.greatest(zero, c("paid") + F.coalesce("residual", zero) - c("drawn"))).withColumn("gross", c("base") * 0.2)
    w = w.withColumn("catch_up", F.least(c("pref") * 0.2 / 0.8, F.greatest(zero, c("paid") - c("roc") - c("pref")))).withColumn("rest", F.greatest(zero, c("paid") - c("roc") - c("pref") - c("catch_up")))
    w = w.withColumn("clawback", F.greatest(zero, c("catch_up") + c("rest") * 0.2 - c("gross"))).withColumn("net", c("gross") - c("clawback")).withColumn("held_back", c("net") * c("holdback")).withColumn("carry_base_all", c("base"))
    return w.select("scheme", "as_of", *[F.round(x, 2).alias(x) for x in ("drawn", "paid", "roc", "pref", "carry_base_all", "catch_up", "gross", "clawback", "net", "held_back")])


CODES = "code AS (SELECT inv_id, CASE WHEN flag = 'R' THEN '1001' WHEN flag = 'A' AND line = 'F' THEN '2105' WHEN flag = 'A' THEN '2003' WHEN line = 'O' THEN '1000' ELSE '4100' END AS dr, CASE WHEN n % 4 = 0 THEN '3000' WHEN n % 4 = 1 THEN '1002' WHEN n % 4 = 2 THEN '2101' ELSE '5001' END AS cr, gross, tax, d FROM recv)"


def codes(t) -> DataFrame:
    """Ledger rows with the accounts that are debited and credited."""
    c = F.col
    dr = ladder([(c("flag") == "R", F.lit("1001")), ((c("flag") == "A") & (c("line") == "F"), F.lit("2105")), (c("flag") == "A", F.lit("2003")), (c("line") == "O", F.lit("1000"))], F.lit("4100"))
    cr = ladder([(c("n") % 4 == i, F.lit(x)) for i, x in enumerate(("3000", "1002", "2101"))], F.lit("5001"))
    return t.recv.select("inv_id", dr.alias("dr"), cr.alias("cr"), "gross", "tax", "d")


LEG_SUMS = {"cash": "100", "fees": "210", "liabilities": "200"}


@query("g24_nav_by_account_codes", f"""WITH {FRAME}, {CODES}, s AS (SELECT scheme, {', '.join(f"sum(CASE WHEN dr LIKE '{p}%' THEN gross ELSE 0 END - CASE WHEN cr LIKE '{p}%' THEN gross ELSE 0 END)::DOUBLE AS l_{n}" for n, p in LEG_SUMS.items())} FROM code JOIN inv USING (inv_id) JOIN co USING (company_id) GROUP BY 1)
  SELECT scheme, round(greatest(coalesce(active_fv, 0) + greatest(l_cash, 0) - abs(l_fees) - abs(l_liabilities), 0), 2) AS nav, round(l_cash, 2) AS cash, round(l_fees, 2) AS fees, round(l_liabilities, 2) AS liabilities FROM f7 JOIN s USING (scheme)""")
def g24(t):
    """Accounts are told by the start of their codes; a leg adds where it is debited and takes where it is credited."""
    c = F.col
    leg = lambda p: F.sum(F.when(c("dr").startswith(p), c("gross")).otherwise(0) - F.when(c("cr").startswith(p), c("gross")).otherwise(0))
    per = codes(t).groupBy("inv_id").agg(*[leg(p).alias(f"l_{n}") for n, p in LEG_SUMS.items()]).join(t.inv.select("inv_id", "company_id"), "inv_id").groupBy("company_id").agg(*[F.sum(f"l_{n}").alias(f"l_{n}") for n in LEG_SUMS])
    s = per.join(owners(t).select("company_id", "scheme"), "company_id").groupBy("scheme").agg(*[dbl(F.sum(f"l_{n}")).alias(f"l_{n}") for n in LEG_SUMS])
    nav = F.greatest(F.coalesce("active_fv", F.lit(0.0)) + F.greatest("l_cash", F.lit(0.0)) - F.abs("l_fees") - F.abs("l_liabilities"), F.lit(0.0))
    return frame(t).join(s, "scheme").select("scheme", F.round(nav, 2).alias("nav"), *[F.round(f"l_{n}", 2).alias(n) for n in LEG_SUMS])


@query("g25_fee_bases", f"WITH {FRAME}, b AS (SELECT scheme, ['committed', 'called', 'nav'][k % 3 + 1] AS basis, CASE k % 3 WHEN 0 THEN committed WHEN 1 THEN called ELSE nav END AS amount FROM f7), q(quarter, starts, ends) AS (VALUES ('Q1', DATE '2000-01-01', DATE '2000-03-31'), ('Q2', DATE '2000-04-01', DATE '2000-06-30')) SELECT scheme, basis, quarter, round(amount * 0.02 * (date_diff('day', starts, ends) + 1) / 365, 2) AS fee, round(round(amount * 0.02 * (date_diff('day', starts, ends) + 1) / 365, 2) * 0.18, 2) AS gst FROM b, q")
def g25(t):
    """On what is committed, called or worth, as the scheme says; days of a period count both ends; halves round up."""
    c = F.col
    amount = ladder([(c("k") % 3 == 0, c("committed")), (c("k") % 3 == 1, c("called"))], c("nav"))
    quarters = F.explode(F.array(*[F.struct(F.lit(n).alias("quarter"), day(a).alias("a"), day(b).alias("b")) for n, a, b in (("Q1", "2000-01-01", "2000-03-31"), ("Q2", "2000-04-01", "2000-06-30"))]))
    fee = F.round(c("amount") * 0.02 * (F.datediff("q.b", "q.a") + 1) / 365, 2)
    rows = frame(t).select("scheme", F.element_at(F.array(*map(F.lit, ("committed", "called", "nav"))), (c("k") % 3 + 1).cast("int")).alias("basis"), amount.alias("amount"), quarters.alias("q"))
    return rows.select("scheme", "basis", "q.quarter", fee.alias("fee"), F.round(fee * 0.18, 2).alias("gst"))


@query("g29_back_fill_ladder", f"WITH {FRAME}, x AS (SELECT company_id, scheme, sum(cost)::DOUBLE AS committed FROM inv JOIN co USING (company_id) GROUP BY 1, 2), l AS (SELECT company_id, sum(gross)::DOUBLE AS lines FROM recv JOIN inv USING (inv_id) WHERE flag = 'A' AND company_id % 3 = 1 GROUP BY 1) SELECT x.company_id, round(CASE WHEN x.company_id % 3 = 0 THEN x.committed * 0.9 WHEN lines IS NOT NULL THEN lines ELSE called * x.committed / invested END, 2) AS called, CASE WHEN x.company_id % 3 = 0 THEN 'extracted' WHEN lines IS NOT NULL THEN 'lines' ELSE 'pro rata' END AS rung FROM x JOIN f7 USING (scheme) LEFT JOIN l USING (company_id)")
def g29(t):
    """What an investor was called for: as extracted, else the sum of lines, else the scheme's total by share of commitments."""
    c = F.col
    x = t.inv.groupBy("company_id").agg(dbl(F.sum("cost")).alias("own")).join(owners(t).select("company_id", "scheme"), "company_id")
    per = t.recv.filter("flag = 'A'").groupBy("inv_id").agg(F.sum("gross").alias("g")).join(t.inv.filter("company_id % 3 = 1").select("inv_id", "company_id"), "inv_id").groupBy("company_id").agg(dbl(F.sum("g")).alias("lines"))
    j = x.join(F.broadcast(frame(t).select("scheme", "called", "invested")), "scheme").join(per, "company_id", "left")  # one row a scheme
    amount, rung = first_of((c("company_id") % 3 == 0, c("own") * 0.9, "extracted"), (c("lines").isNotNull(), c("lines"), "lines"), (F.lit(True), c("called") * c("own") / c("invested"), "pro rata"))
    return j.select("company_id", F.round(amount, 2).alias("called"), rung.alias("rung"))


@query("g32_reconcile_with_value", "WITH i AS (SELECT company_id, sum(cost)::DOUBLE AS total_invested, min(d) AS investment_date, arg_max(stage, (d, inv_id)) AS latest_round FROM inv GROUP BY 1), s AS (SELECT company_id, arg_max(qty, (r.d, r.inv_id, n, part_id)) AS stake FROM recv r JOIN inv USING (inv_id) GROUP BY 1), v AS (SELECT holding_id AS company_id, arg_max(fair, (ts, val_id))::DOUBLE AS fv FROM val WHERE val_id % 2 = 0 GROUP BY 1) SELECT * FROM i LEFT JOIN s USING (company_id) LEFT JOIN v USING (company_id)")
def g32(t):
    """An investment from its tranches: sum, first day, newest round and stake, and the newest approved value, if there is one."""
    i = t.inv.groupBy("company_id").agg(dbl(F.sum("cost")).alias("total_invested"), F.min("d").alias("investment_date"), F.max_by("stage", F.struct("d", "inv_id")).alias("latest_round"))
    at = F.struct("d", "inv_id", "n", "part_id")
    per = t.recv.groupBy("inv_id").agg(F.max(F.struct(at.alias("at"), "qty")).alias("x")).join(t.inv.select("inv_id", "company_id"), "inv_id").groupBy("company_id").agg(F.max("x").alias("x")).select("company_id", F.col("x.qty").alias("stake"))
    v = t.val.filter("val_id % 2 = 0").groupBy(F.col("holding_id").alias("company_id")).agg(dbl(F.max_by("fair", F.struct("ts", "val_id"))).alias("fv"))
    return i.join(per, "company_id", "left").join(v, "company_id", "left")


@query("g35_level1_as_of", "WITH p AS (SELECT part_id, arg_max(gross::DOUBLE / qty, (d, inv_id, n)) AS price FROM recv WHERE d <= DATE '1999-06-30' GROUP BY 1), o AS (SELECT holding_id AS part_id, arg_max(holding, (ts, val_id))::DOUBLE / 1000 AS dlom FROM val WHERE methodology = 'click' GROUP BY 1) SELECT p_partkey AS part_id, round(price * p_size * (1 - coalesce(dlom, 0)), 6) AS value FROM part LEFT JOIN p ON part_id = p_partkey LEFT JOIN o ON o.part_id = p_partkey")
def g35(t):
    """The newest price up to the day, times shares, less the discount that the previous level 1 value had, if there was one."""
    c = F.col
    p = t.recv.filter("d <= date'1999-06-30'").groupBy("part_id").agg(F.max_by(dbl("gross") / c("qty"), F.struct("d", "inv_id", "n")).alias("price"))
    o = t.val.filter("methodology = 'click'").groupBy(c("holding_id").alias("part_id")).agg((dbl(F.max_by("holding", F.struct("ts", "val_id"))) / 1000).alias("dlom"))
    part = t.part.select(c("p_partkey").alias("part_id"), "p_size").join(p, "part_id", "left").join(o, "part_id", "left")
    return part.select("part_id", F.round(c("price") * c("p_size") * (1 - F.coalesce("dlom", F.lit(0.0))), 6).alias("value"))


@query("g36_peer_multiples", f"""WITH {FEATURES}, b AS (SELECT company_id, sector, revenue, ebitda FROM a JOIN (SELECT company_id, sector FROM company) USING (company_id)), ev AS (SELECT b.*, cash::DOUBLE * 10 AS ev FROM b JOIN company USING (company_id, sector)), m AS (SELECT sector, avg(ev / nullif(revenue, 0)) AS by_revenue, avg(CASE WHEN ebitda > 0 THEN ev / ebitda END) AS by_ebitda FROM ev WHERE ev > 0 GROUP BY 1)
  SELECT company_id, round(CASE WHEN revenue * by_revenue IS NOT NULL AND ebitda > 0 AND by_ebitda IS NOT NULL THEN (revenue * by_revenue + ebitda * by_ebitda) / 2 WHEN revenue * by_revenue IS NOT NULL THEN revenue * by_revenue WHEN ebitda > 0 THEN ebitda * by_ebitda END * 0.15 * 0.8, 2) AS value FROM ev LEFT JOIN m USING (sector)""")
def g36(t):
    """Mean of the values by the sector's revenue and EBITDA multiples where both are there, else the one that is; times stake, less discount."""
    c = F.col
    newest = mis(t).groupBy("company_id").agg(F.max_by(F.struct("revenue", (c("revenue") - c("costs")).alias("ebitda")), "q").alias("x")).select("company_id", "x.*")
    ev = newest.join(t.company.select("company_id", "sector", (dbl("cash") * 10).alias("ev")), "company_id")
    m = ev.filter("ev > 0").groupBy("sector").agg(F.avg(F.try_divide("ev", F.nullif("revenue", F.lit(0.0)))).alias("by_revenue"), F.avg(F.when(c("ebitda") > 0, c("ev") / c("ebitda"))).alias("by_ebitda"))
    j = ev.join(F.broadcast(m), "sector", "left").withColumn("r", c("revenue") * c("by_revenue")).withColumn("e", F.when(c("ebitda") > 0, c("ebitda") * c("by_ebitda")))  # one row a sector
    value = F.coalesce((c("r") + c("e")) / 2, "r", "e")
    return j.select("company_id", F.round(value * 0.15 * 0.8, 2).alias("value"))


GIVEN = {"revenue": "n % 5 <> 4", "cogs": "n % 4 <> 3", "rd": "n % 3 = 0", "marketing": "n % 2 = 0", "ebitda": "n % 11 = 0", "customers": "n % 7 <> 6", "new_customers": "n % 6 <> 5", "arr": "n % 3 = 1", "mrr": "n % 3 = 2", "churn": "n % 4 = 1", "churned": "n % 4 = 2", "gmv": "n % 5 <> 1", "orders": "n % 5 <> 2", "aov": "n % 5 = 1", "take_rate": "n % 2 = 1"}
SIZES = {"revenue": "v * 3", "cogs": "v", "rd": "v / 4", "marketing": "v / 5", "ebitda": "v / 2", "customers": "v * 10", "new_customers": "v", "arr": "v * 2", "mrr": "v / 6", "churn": "v / 500 + 0.01", "churned": "v / 10", "gmv": "v * 8", "orders": "v * 100", "aov": "v * 50", "take_rate": "v / 40"}


@query("g48_full_ladder", f"""WITH k AS (SELECT val_id, {', '.join(f'CASE WHEN {GIVEN[x]} THEN {SIZES[x]} END AS {x}' for x in GIVEN)} FROM (SELECT val_id, val_id % 1155 AS n, fair::DOUBLE + 1 AS v FROM val)),
  l AS (SELECT *, revenue > 0 AND cogs IS NOT NULL AS pl FROM k), m AS (SELECT *, CASE WHEN pl THEN revenue - cogs END AS gross_profit, coalesce(ebitda, CASE WHEN pl THEN revenue - cogs - coalesce(rd, 0) - coalesce(marketing, 0) END) AS ebitda2, CASE WHEN marketing > 0 AND new_customers > 0 THEN marketing * 1e7 / new_customers END AS cac, CASE WHEN arr > 0 AND customers > 0 AND churn > 0 AND pl THEN arr / customers * ((revenue - cogs) / revenue) / churn * 1e7 END AS ltv FROM l)
  SELECT val_id, round(gross_profit, 4) AS gross_profit, round(CASE WHEN pl THEN (revenue - cogs) / revenue * 100 END, 4) AS gross_margin_pct, round(ebitda2, 4) AS ebitda, round(CASE WHEN pl THEN ebitda2 / revenue * 100 END, 4) AS ebitda_margin_pct, round(cac, 2) AS cac, round(ltv, 2) AS ltv, round(ltv / nullif(cac, 0), 4) AS ltv_cac_ratio, round(coalesce(arr, mrr * 12), 4) AS arr, round(coalesce(mrr, arr / 12), 4) AS mrr,
  round(coalesce(aov, CASE WHEN orders > 0 THEN gmv * 1e7 / orders END), 2) AS aov, round(coalesce(orders, CASE WHEN aov > 0 THEN gmv * 1e7 / aov END), 2) AS orders, round(coalesce(gmv, orders * aov / 1e7), 4) AS gmv, round(coalesce(churn, CASE WHEN customers > 0 THEN churned / customers * 100 END), 4) AS churn, round(coalesce(revenue, CASE WHEN gmv > 0 AND take_rate > 0 THEN gmv * take_rate / 100 END), 4) AS revenue FROM m""")
def g48(t):
    """Figures that aren't given are derived from given ones, in the order of the ladder; a given one is never replaced, and what was derived late (churn, revenue, GMV) doesn't feed what came before."""
    c, zero = F.col, F.lit(0.0)
    k = t.val.select("val_id", (c("val_id") % 1155).alias("n"), (dbl("fair") + 1).alias("v")).select("val_id", *[F.when(F.expr(GIVEN[x]), F.expr(SIZES[x])).alias(x) for x in GIVEN])
    pl = (c("revenue") > 0) & c("cogs").isNotNull()
    k = k.withColumn("gross_profit", F.when(pl, c("revenue") - c("cogs"))).withColumn("ebitda", F.coalesce("ebitda", c("gross_profit") - F.coalesce("rd", zero) - F.coalesce("marketing", zero)))
    k = k.withColumn("gross_margin_pct", F.when(pl, c("gross_profit") / c("revenue") * 100)).withColumn("ebitda_margin_pct", F.when(pl, c("ebitda") / c("revenue") * 100))
    k = k.withColumn("cac", F.when((c("marketing") > 0) & (c("new_customers") > 0), c("marketing") * 1e7 / c("new_customers")))
    k = k.withColumn("ltv", F.when((c("arr") > 0) & (c("customers") > 0) & (c("churn") > 0) & pl, c("arr") / c("customers") * (c("gross_profit") / c("revenue")) / c("churn") * 1e7)).withColumn("ltv_cac_ratio", F.try_divide("ltv", F.nullif("cac", zero)))
    late = {"arr": c("mrr") * 12, "mrr": c("arr") / 12, "aov": F.when(c("orders") > 0, c("gmv") * 1e7 / c("orders")), "orders": F.when(c("aov") > 0, c("gmv") * 1e7 / c("aov")), "gmv": c("orders") * c("aov") / 1e7, "churn": F.when(c("customers") > 0, c("churned") / c("customers") * 100), "revenue": F.when((c("gmv") > 0) & (c("take_rate") > 0), c("gmv") * c("take_rate") / 100)}
    digits = {"cac": 2, "ltv": 2, "aov": 2, "orders": 2}
    early = ("gross_profit", "gross_margin_pct", "ebitda", "ebitda_margin_pct", "cac", "ltv", "ltv_cac_ratio")
    return k.select("val_id", *[F.round(x, digits.get(x, 4)).alias(x) for x in early], *[F.round(F.coalesce(x, y), digits.get(x, 4)).alias(x) for x, y in late.items()])


@query("g51_three_statements", f"""WITH {CODES}, leg AS (SELECT dr AS code, cr AS counter, gross, d FROM code UNION ALL SELECT cr, dr, -gross, d FROM code)
  SELECT 'bs' AS statement, year(d)::INT AS fy, CASE left(code, 1) WHEN '1' THEN 'assets' WHEN '2' THEN 'liabilities' ELSE 'equity' END AS line, sum(gross * CASE WHEN code LIKE '1%' THEN 1 ELSE -1 END)::DOUBLE AS amount FROM leg WHERE left(code, 1) IN ('1', '2', '3') GROUP BY 2, 3
  UNION ALL SELECT 'is', year(d)::INT, CASE left(code, 1) WHEN '4' THEN 'income' ELSE 'expenses' END, sum(gross * CASE WHEN code LIKE '4%' THEN -1 ELSE 1 END)::DOUBLE FROM leg WHERE left(code, 1) IN ('4', '5') GROUP BY 2, 3
  UNION ALL SELECT 'cf', year(d)::INT, CASE WHEN left(counter, 1) IN ('4', '5') THEN 'operating' WHEN counter LIKE '11%' THEN 'investing' WHEN counter LIKE '3%' THEN 'financing' ELSE 'other' END, sum(gross)::DOUBLE FROM leg WHERE code = '1000' GROUP BY 2, 3""")
def g51(t):
    """Balance sheet, income and cash flow by fiscal year, from both legs of each ledger row; cash is the account 1000 alone, and its activity is told by the account on the other side."""
    c = F.col
    both = F.explode(F.array(F.struct(c("dr").alias("code"), c("cr").alias("counter"), c("gross").alias("amount")), F.struct(c("cr").alias("code"), c("dr").alias("counter"), (-c("gross")).alias("amount"))))
    leg = codes(t).select(F.year("d").alias("fy"), both.alias("x")).select("fy", "x.*").withColumn("kind", F.substring("code", 1, 1))
    lines = {"1": ("bs", "assets", 1), "2": ("bs", "liabilities", -1), "3": ("bs", "equity", -1), "4": ("is", "income", -1), "5": ("is", "expenses", 1)}
    of = lambda i: ladder([(c("kind") == k, F.lit(v[i])) for k, v in lines.items()], F.lit(None))
    books = leg.groupBy(of(0).alias("statement"), "fy", of(1).alias("line")).agg(dbl(F.sum(c("amount") * of(2))).alias("amount"))
    activity = ladder([(F.substring("counter", 1, 1).isin("4", "5"), F.lit("operating")), (c("counter").startswith("11"), F.lit("investing")), (c("counter").startswith("3"), F.lit("financing"))], F.lit("other"))
    cash = leg.filter("code = '1000'").groupBy(F.lit("cf").alias("statement"), "fy", activity.alias("line")).agg(dbl(F.sum("amount")).alias("amount"))
    return books.unionByName(cash)


EXIT = f"""{FEATURES}, g AS (SELECT company_id, sum(cost)::DOUBLE AS cost, min(d) AS first FROM inv GROUP BY 1), {LATEST_VAL}, x AS (SELECT g.company_id, lv.fv::DOUBLE * 10000 / nullif(cost, 0) AS moic, 2002 - year(first) AS age, revenue_qoq, ebitda_margin FROM g LEFT JOIN lv ON holding_id = g.company_id LEFT JOIN f USING (company_id)),
s AS (SELECT *, greatest(0, least(100, 50 + CASE WHEN moic IS NULL THEN 0 WHEN moic >= 5 THEN 30 WHEN moic >= 3 THEN 20 WHEN moic >= 2 THEN 10 ELSE -10 END + CASE WHEN age >= 8 THEN 25 WHEN age >= 6 THEN 15 ELSE 0 END + CASE WHEN revenue_qoq > 20 THEN 15 WHEN revenue_qoq < -10 THEN -10 ELSE 0 END + CASE WHEN ebitda_margin > 20 THEN 10 ELSE 0 END)) AS score FROM x)"""


@query("g55_exit_four_factors", f"WITH {EXIT} SELECT company_id, round(moic, 4) AS moic, age::INT AS age, score::INT AS score, CASE WHEN score >= 70 THEN 'immediate' WHEN score >= 55 THEN '1_year' WHEN score >= 40 THEN '2_year' ELSE 'hold' END AS timing FROM s")
def g55(t):
    """Fifty, and points for multiple, age of the fund, growth and margin; an unknown factor counts nothing. Clamped to 0 and 100."""
    c = F.col
    g = t.inv.groupBy("company_id").agg(dbl(F.sum("cost")).alias("cost"), (2002 - F.year(F.min("d"))).alias("age"))
    lv = latest_valuation(t).select(c("holding_id").alias("company_id"), dbl("fv").alias("fv"))
    x = g.join(lv, "company_id", "left").join(features(t), "company_id", "left").withColumn("moic", F.try_divide(c("fv") * 10000, F.nullif(c("cost"), F.lit(0.0))))
    step = lambda *rungs, last=0: ladder([(cond, F.lit(n)) for cond, n in rungs], F.lit(last))
    points = step((c("moic").isNull(), 0), (c("moic") >= 5, 30), (c("moic") >= 3, 20), (c("moic") >= 2, 10), last=-10) + step((c("age") >= 8, 25), (c("age") >= 6, 15)) + step((c("revenue_qoq") > 20, 15), (c("revenue_qoq") < -10, -10)) + step((c("ebitda_margin") > 20, 10))
    x = x.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), 50 + points)))
    return x.select("company_id", F.round("moic", 4).alias("moic"), "age", "score", ladder([(c("score") >= 70, F.lit("immediate")), (c("score") >= 55, F.lit("1_year")), (c("score") >= 40, F.lit("2_year"))], F.lit("hold")).alias("timing"))


@query("g57_exit_probability", f"WITH {EXIT}, st AS (SELECT company_id, arg_max(['series a', 'series d', 'pre-ipo', 'seed', 'buyout'][left(stage, 1)::INT], (d, inv_id)) AS stage FROM inv GROUP BY 1), p AS (SELECT company_id, coalesce(moic, 1.0) AS m, stage, company_id % 4 = 0 AS risky FROM x JOIN st USING (company_id)) SELECT company_id, stage, round(m, 4) AS moic, CASE WHEN m >= 3 AND (contains(stage, 'pre-ipo') OR contains(stage, 'series d') OR contains(stage, 'buyout')) THEN 55 WHEN m >= 2 THEN 30 WHEN m < 1 OR risky THEN 10 ELSE 20 END AS probability, CASE WHEN m >= 3 AND (contains(stage, 'pre-ipo') OR contains(stage, 'series d') OR contains(stage, 'buyout')) THEN 'IPO' WHEN m >= 2 THEN 'Strategic Sale' WHEN m < 1 OR risky THEN 'Write-off' ELSE 'Secondary' END AS kind FROM p")
def g57(t):
    """How likely a company is sold within a year, and how: by multiple (1 if unknown), stage and risk."""
    c = F.col
    named = F.element_at(F.array(*map(F.lit, ("series a", "series d", "pre-ipo", "seed", "buyout"))), F.substring("stage", 1, 1).cast("int"))
    g = t.inv.groupBy("company_id").agg(dbl(F.sum("cost")).alias("cost"), F.max_by(named, F.struct("d", "inv_id")).alias("stage"))
    lv = latest_valuation(t).select(c("holding_id").alias("company_id"), dbl("fv").alias("fv"))
    p = g.join(lv, "company_id", "left").withColumn("m", F.coalesce(F.try_divide(c("fv") * 10000, F.nullif(c("cost"), F.lit(0.0))), F.lit(1.0)))
    rungs = [((c("m") >= 3) & c("stage").isin("pre-ipo", "series d", "buyout"), 55, "IPO"), (c("m") >= 2, 30, "Strategic Sale"), ((c("m") < 1) | (c("company_id") % 4 == 0), 10, "Write-off"), (F.lit(True), 20, "Secondary")]
    return p.select("company_id", "stage", F.round("m", 4).alias("moic"), ladder([(x, F.lit(n)) for x, n, _ in rungs], F.lit(None)).alias("probability"), ladder([(x, F.lit(s)) for x, _, s in rungs], F.lit(None)).alias("kind"))


COMPLIANCE = """f AS (SELECT fund, count(*) FILTER (inv_id % 3 = 0) AS reports, count(*) FILTER (inv_id % 3 = 0 AND status = 'O' AND d < DATE '1998-01-01') AS late, count(*) FILTER (inv_id % 7 = 0 AND status <> 'P') AS actions, count(*) FILTER (inv_id % 7 = 0 AND status = 'O' AND d < DATE '1999-01-01') AS late_actions,
  count(*) FILTER (cost > 499000) AS urgent, count(*) FILTER (cost > 498000 AND cost <= 499000) AS high, count(*) FILTER (cost > 497500 AND cost <= 498000) AS medium FROM inv JOIN company USING (company_id) GROUP BY 1),
l AS (SELECT r_name AS fund, count(*) AS investors, count(*) FILTER (s_acctbal < 0) AS risky, count(*) FILTER (s_suppkey % 50 = 7) AS unassessed FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1), p AS (SELECT fund, avg(fair::DOUBLE % 100) AS mean FROM (SELECT holding_id, arg_max(fair, (ts, val_id)) AS fair FROM val GROUP BY 1) JOIN company ON company_id = holding_id GROUP BY 1),
s AS (SELECT fund, CASE WHEN reports = 0 THEN 100 ELSE round(greatest(0, 100 - late::DOUBLE / reports * 100), 2) END AS filing, CASE WHEN coalesce(investors, 0) = 0 THEN 100 ELSE greatest(0, 100 - risky * 10 - unassessed * 5) END::DOUBLE AS aml, greatest(0, 100 - urgent * 30 - high * 15 - medium * 5)::DOUBLE AS equity, round(coalesce(mean, 100), 2) AS portfolio, CASE WHEN actions = 0 THEN 100 ELSE round(greatest(0, 100 - late_actions::DOUBLE / actions * 100), 2) END AS circulars FROM f LEFT JOIN l USING (fund) LEFT JOIN p USING (fund))"""


@query("k01_five_subscores", f"WITH {COMPLIANCE} SELECT fund, filing::DOUBLE AS filing, aml, equity, portfolio, circulars::DOUBLE AS circulars, round(filing * 0.3 + aml * 0.2 + equity * 0.2 + portfolio * 0.2 + circulars * 0.1, 1)::DOUBLE AS combined FROM s")
def k01(t):
    """Five sub-scores, each 100 where there is nothing to score: shares of late reports and actions, deductions for investors and for open alerts, mean of the companies."""
    c, n = F.col, F.count_if
    i = t.inv.groupBy("company_id").agg(
        n(c("inv_id") % 3 == 0).alias("reports"), n((c("inv_id") % 3 == 0) & (c("status") == "O") & (c("d") < day("1998-01-01"))).alias("late"), n((c("inv_id") % 7 == 0) & (c("status") != "P")).alias("actions"), n((c("inv_id") % 7 == 0) & (c("status") == "O") & (c("d") < day("1999-01-01"))).alias("late_actions"),
        n(c("cost") > 499000).alias("urgent"), n((c("cost") > 498000) & (c("cost") <= 499000)).alias("high"), n((c("cost") > 497500) & (c("cost") <= 498000)).alias("medium"),
    )
    f = i.join(t.company.select("company_id", "fund"), "company_id").groupBy("fund").agg(*[F.sum(x).alias(x) for x in i.columns[1:]])
    l = t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).join(t.region, c("n_regionkey") == c("r_regionkey")).groupBy(c("r_name").alias("fund")).agg(F.count("*").alias("investors"), n(c("s_acctbal") < 0).alias("risky"), n(c("s_suppkey") % 50 == 7).alias("unassessed"))
    p = t.val.groupBy(c("holding_id").alias("company_id")).agg(F.max_by("fair", F.struct("ts", "val_id")).alias("fair")).join(t.company.select("company_id", "fund"), "company_id").groupBy("fund").agg(F.avg(dbl("fair") % 100).alias("mean"))
    share = lambda late, of: F.when(c(of) == 0, 100.0).otherwise(F.round(F.greatest(F.lit(0.0), 100 - F.try_divide(late, F.nullif(c(of), F.lit(0))) * 100), 2))
    left = lambda x: F.greatest(F.lit(0), x).cast("double")
    s = f.join(l, "fund", "left").join(p, "fund", "left").select(
        "fund", share("late", "reports").alias("filing"), F.when(F.coalesce("investors", F.lit(0)) == 0, 100.0).otherwise(left(100 - c("risky") * 10 - c("unassessed") * 5)).alias("aml"), left(100 - c("urgent") * 30 - c("high") * 15 - c("medium") * 5).alias("equity"),
        F.round(F.coalesce("mean", F.lit(100.0)), 2).alias("portfolio"), share("late_actions", "actions").alias("circulars"),
    )
    return s.withColumn("combined", F.round(c("filing") * 0.3 + c("aml") * 0.2 + c("equity") * 0.2 + c("portfolio") * 0.2 + c("circulars") * 0.1, 1))


@query("k02_escalation_scan", "WITH late AS (SELECT inv_id, date_diff('day', d, DATE '1998-06-30') AS days, inv_id % 2 = 0 AS report FROM inv WHERE status = 'O' AND d < DATE '1998-06-30' AND d > DATE '1998-05-01'), o AS (SELECT DISTINCT inv_id FROM recv WHERE flag = 'N' AND n = 1), e AS (SELECT inv_id, CASE WHEN report THEN 'report' ELSE 'action' END AS kind, CASE WHEN days > CASE WHEN report THEN 14 ELSE 21 END THEN 3 WHEN days > 7 THEN 2 ELSE 1 END AS level FROM late WHERE inv_id NOT IN (SELECT inv_id FROM o)), a AS (SELECT inv_id, 'breach' AS kind, unnest(range(1, CASE WHEN cost > 400000 THEN 4 WHEN cost > 300000 THEN 3 ELSE 2 END)) AS level FROM inv WHERE status = 'P' AND inv_id % 5 <> 0) SELECT inv_id, kind, level::INT AS level FROM e UNION ALL SELECT inv_id, kind, level::INT FROM a")
def k02(t):
    """Late reports and actions go to a level by their days, unless an escalation of theirs is open; a breach goes to as many levels as its severity says, once."""
    c = F.col
    late = t.inv.filter("status = 'O' and d < date'1998-06-30' and d > date'1998-05-01'").select("inv_id", F.datediff(day("1998-06-30"), "d").alias("days"), (c("inv_id") % 2 == 0).alias("report"))
    logged = t.recv.filter("flag = 'N' and n = 1").select("inv_id").distinct()
    level = ladder([(c("days") > F.when(c("report"), 14).otherwise(21), F.lit(3)), (c("days") > 7, F.lit(2))], F.lit(1))
    e = late.join(logged, "inv_id", "left_anti").select("inv_id", F.when(c("report"), "report").otherwise("action").alias("kind"), level.alias("level"))
    reach = ladder([(c("cost") > 400000, F.lit(3)), (c("cost") > 300000, F.lit(2))], F.lit(1))
    a = t.inv.filter("status = 'P' and inv_id % 5 <> 0").select("inv_id", F.lit("breach").alias("kind"), F.explode(F.sequence(F.lit(1), reach)).alias("level"))
    return e.unionByName(a)


@query("k08_bva_frame", f"WITH {PL} SELECT node, period, round(prior_revenue, 2) AS budget, round(ytd_revenue, 2) AS actual, round(ytd_revenue - prior_revenue, 2) AS variance, CASE WHEN abs((ytd_revenue - prior_revenue) / nullif(prior_revenue, 0)) > 0.25 THEN 'review' ELSE 'ok' END AS flag FROM yr")
def k08_bva(t):
    c = F.col
    off = F.abs(F.try_divide(c("ytd_revenue") - c("prior_revenue"), F.nullif(c("prior_revenue"), F.lit(0.0))))
    return yearly(t).select("node", "period", F.round("prior_revenue", 2).alias("budget"), F.round("ytd_revenue", 2).alias("actual"), F.round(c("ytd_revenue") - c("prior_revenue"), 2).alias("variance"), F.when(off > 0.25, "review").otherwise("ok").alias("flag"))


@query("k08_valuation_frame", "SELECT company, sector, d, methodology, fair::DOUBLE AS fair_value, coalesce(holding, fair)::DOUBLE AS holding, 'L' || (val_id % 3 + 1) AS level FROM val JOIN company ON company_id = holding_id WHERE methodology <> 'error'")
def k08_valuation(t):
    v = t.val.filter("methodology <> 'error'").withColumnRenamed("holding_id", "company_id").join(t.company.select("company_id", "company", "sector"), "company_id")
    return v.select("company", "sector", "d", "methodology", dbl("fair").alias("fair_value"), dbl(F.coalesce("holding", "fair")).alias("holding"), F.concat(F.lit("L"), (F.col("val_id") % 3 + 1).cast("string")).alias("level"))


@query("k08_lp_statement_frame", "WITH x AS (SELECT payer_id, d, n, sum(gross) AS called, sum(CASE WHEN flag = 'R' THEN net ELSE 0 END) AS paid FROM recv GROUP BY 1, 2, 3) SELECT payer_id, d, n, called::DOUBLE AS called, paid::DOUBLE AS paid, sum(called) OVER w::DOUBLE AS called_so_far, (sum(paid) OVER w - sum(called) OVER w)::DOUBLE AS balance FROM x WINDOW w AS (PARTITION BY payer_id ORDER BY d, n)")
def k08_lp(t):
    """An investor's statement with running totals, by day."""
    x = t.recv.groupBy("payer_id", "d", "n").agg(F.sum("gross").alias("called"), F.sum(F.when(F.col("flag") == "R", F.col("net")).otherwise(0)).alias("paid"))
    w = Window.partitionBy("payer_id").orderBy("d", "n").rowsBetween(Window.unboundedPreceding, 0)  # an investor has a row a day and line
    return x.select("payer_id", "d", "n", dbl("called").alias("called"), dbl("paid").alias("paid"), dbl(F.sum("called").over(w)).alias("called_so_far"), dbl(F.sum("paid").over(w) - F.sum("called").over(w)).alias("balance"))


@query("k08_compliance_frame", "SELECT fund, sector, status, count(*) AS n, min(d) AS oldest, count(*) FILTER (d < DATE '1998-01-01') AS overdue FROM inv JOIN company USING (company_id) GROUP BY 1, 2, 3")
def k08_compliance(t):
    per = t.inv.groupBy("company_id", "status").agg(F.count("*").alias("n"), F.min("d").alias("oldest"), F.count_if(F.col("d") < day("1998-01-01")).alias("overdue"))
    return per.join(t.company.select("company_id", "fund", "sector"), "company_id").groupBy("fund", "sector", "status").agg(F.sum("n").alias("n"), F.min("oldest").alias("oldest"), F.sum("overdue").alias("overdue"))


@query("k08_portfolio_frame", f"WITH {LATEST_VAL}, i AS (SELECT company_id, sum(cost)::DOUBLE AS cost, count(*) AS rounds, bool_or(status = 'O') AS active FROM inv GROUP BY 1) SELECT company, sector, segment, rounds, i.cost, lv.fv::DOUBLE AS fv, CASE WHEN active THEN 'active' ELSE 'exited' END AS state FROM company JOIN i USING (company_id) LEFT JOIN lv ON holding_id = company_id")
def k08_portfolio(t):
    i = t.inv.groupBy("company_id").agg(dbl(F.sum("cost")).alias("cost"), F.count("*").alias("rounds"), F.max(F.col("status") == "O").alias("active"))
    lv = latest_valuation(t).select(F.col("holding_id").alias("company_id"), dbl("fv").alias("fv"))
    return t.company.join(i, "company_id").join(lv, "company_id", "left").select("company", "sector", "segment", "rounds", "cost", "fv", F.when(F.col("active"), "active").otherwise("exited").alias("state"))


@query("k08_tds_frame", "SELECT fund, CASE WHEN month(d) >= 4 THEN year(d) + 1 ELSE year(d) END::INT AS fy, count(*) AS payments, sum(cost)::DOUBLE AS gross, sum(round(cost * 0.1, 2)::DECIMAL(18,2))::DOUBLE AS tax FROM inv JOIN company USING (company_id) GROUP BY 1, 2")
def k08_tds(t):
    x = t.inv.select("company_id", F.year(F.add_months("d", 9)).alias("fy"), "cost", F.expr("cast(round(cost * 0.1, 2) as decimal(18,2))").alias("tax"))
    per = x.groupBy("company_id", "fy").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.sum("tax").alias("tax"))
    g = per.join(t.company.select("company_id", "fund"), "company_id").groupBy("fund", "fy").agg(F.sum("n").alias("payments"), F.sum("cost").alias("g"), F.sum("tax").alias("t"))
    return g.select("fund", "fy", "payments", dbl("g").alias("gross"), dbl("t").alias("tax"))


@query("k09_data_pack", f"""WITH {FRAME}, {PL}
  SELECT 'figures' AS block, scheme AS key, metric AS field, value FROM (SELECT scheme, unnest(['called', 'distributed', 'nav', 'tvpi']) AS metric, unnest([round(called, 2), round(distributed, 2), round(nav, 2), round(tvpi, 4)]) AS value FROM f7)
  UNION ALL SELECT 'pl', node, metric, value FROM (SELECT node, unnest(['ytd_revenue', 'ytd_ebitda']) AS metric, unnest([round(ytd_revenue, 2), round(ytd_ebitda, 2)]) AS value FROM yr)
  UNION ALL SELECT 'sectors', sector, 'companies', count(*)::DOUBLE FROM company GROUP BY sector UNION ALL SELECT 'stages', stage, 'cost', sum(cost)::DOUBLE FROM inv GROUP BY stage
  UNION ALL SELECT 'exits', status, 'n', count(*)::DOUBLE FROM inv GROUP BY status UNION ALL SELECT 'flows', strftime(d, '%Y'), flag, sum(net)::DOUBLE FROM recv GROUP BY 2, flag UNION ALL SELECT 'readings', methodology, 'n', count(*)::DOUBLE FROM val GROUP BY methodology""")
def k09(t):
    """The blocks of the comprehensive report as one list: block, key, field, value."""
    c = F.col

    def block(name: str, df: DataFrame, key: Column, values: dict[str, Column]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), dbl(v).alias("value")) for n, v in values.items()]))
        return df.select(F.lit(name).alias("block"), key.alias("key"), each.alias("x")).select("block", "key", "x.field", "x.value")

    rows = lambda df: df.agg(F.count("*").alias("n"))
    parts = [
        block("figures", frame(t), c("scheme"), {"called": F.round("called", 2), "distributed": F.round("distributed", 2), "nav": F.round("nav", 2), "tvpi": F.round("tvpi", 4)}),
        block("pl", yearly(t), c("node"), {"ytd_revenue": F.round("ytd_revenue", 2), "ytd_ebitda": F.round("ytd_ebitda", 2)}),
        block("sectors", rows(t.company.groupBy("sector")), c("sector"), {"companies": c("n")}),
        block("stages", t.inv.groupBy("stage").agg(F.sum("cost").alias("cost")), c("stage"), {"cost": c("cost")}),
        block("exits", rows(t.inv.groupBy("status")), c("status"), {"n": c("n")}),
        t.recv.groupBy(F.date_format("d", "yyyy").alias("key"), c("flag").alias("field")).agg(dbl(F.sum("net")).alias("value")).select(F.lit("flows").alias("block"), "key", "field", "value"),
        block("readings", rows(t.val.groupBy("methodology")), c("methodology"), {"n": c("n")}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
