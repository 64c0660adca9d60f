"""Extracted rows to the blocks of a fund's record (inventory I10).

A row comes with its sheet's domain, its source sheet and whatever fields it has. One pass gives it the array of blocks whose signature it shows, then it is exploded: a row may go to two
blocks. Rows that are derived from others (an exit as a distribution, a valuation from an investment, net asset values from lines) and dates that are borrowed are joins by company or period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import dbl, few

# The fields that tell a call, a valuation, a KPI, a net asset value and a ledger row, and the lines that are a net asset value.
CALL = ("call_date", "call_number", "call_ref")
VALUATION = ("fair_value", "methodology", "valuer_name")
READING = ("arr", "headcount", "kpi_name")
NAV = ("total_nav", "investments_at_cost")
LEDGER = ("description", "net_movement")
NAV_LINES = ("closing_fund_nav", "closing_nav", "total_nav", "net_asset_value", "fund_nav", "net_nav", "total_fund_nav", "gross_nav", "closing_fund_nav_cr", "closing_nav_cr", "total_fund_nav_cr", "closing_nav_before_carry", "net_asset_value_closing_nav")
#: Fields of the rows that are routed.
TEXTS = ("source_sheet", "investor_name", "company_name", "call_number", "call_ref", "distribution_number", "period", "proceeds", "methodology", "valuer_name", "kpi_name", "description", "line_item")
DATES, NUMBERS = ("call_date", "distribution_date", "exit_date", "valuation_date"), ("total_gross_amount", "total_net_amount", "fair_value", "arr", "headcount", "total_nav", "investments_at_cost", "net_movement", "period_value", "budget", "actual", "total_invested")
MONEY = "decimal(18,4)"


def present(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string") != "", F.lit(False))


def any_of(names: tuple[str, ...]) -> Column:
    return F.greatest(*[present(n) for n in names])


def bundled(sheet: Column) -> Column:
    """A sheet that by its name holds exits and distributions."""
    s = F.lower(F.coalesce(sheet, F.lit("")))
    return (s.contains("exit") | s.contains("realiz") | s.contains("realis")) & (s.contains("distribution") | s.contains("payout"))


def is_distribution() -> Column:
    """By its date; an exit by its sheet only; else by a number that is one and an amount, or by a period and an amount."""
    number, amount = F.col("distribution_number"), F.col("total_gross_amount").isNotNull() | F.col("total_net_amount").isNotNull()
    numeric = F.coalesce((F.length(number) < 12) & number.rlike("[0-9]"), F.lit(False))
    return F.when(present("distribution_date"), True).when(present("exit_date"), bundled(F.col("source_sheet"))).otherwise(amount & (numeric | present("period")))


def blocks() -> Column:
    """The blocks that a row goes to, by its domain and shape."""
    d, on = F.col("domain"), lambda cond, block: F.when(cond, F.lit(block))
    call, valuation, reading, nav = any_of(CALL), any_of(VALUATION), any_of(READING), any_of(NAV)
    planned = F.col("budget").isNotNull() | F.col("actual").isNotNull()
    of = {
        "commitments": [on(present("investor_name"), "commitments")],
        "capital_calls": [on(call, "capital_calls"), on(~call & present("investor_name"), "rerouted")],
        "exits_distributions": [on(is_distribution(), "distributions"), on(present("exit_date"), "exits")],
        "valuations_kpis": [on(valuation | ~reading, "valuations"), on(reading, "portfolio_kpis")],
        "portfolio_investments": [F.lit("portfolio_investments"), on(present("company_name") & F.col("fair_value").isNotNull(), "valuations")],
        "nav_accounting": [on(nav & ~any_of(LEDGER), "nav_records"), on(~nav | any_of(LEDGER), "fund_ledger")],
        "nav_calculation": [on(nav, "nav_records")],
        "financials_pl_bva": [on(planned, "budget_vs_actual"), on(~planned & present("company_name"), "portfolio_kpis")],
    }
    out = F.array().cast("array<string>")
    for domain, targets in of.items():
        out = F.when(d == domain, F.array_compact(F.array(*targets))).otherwise(out)
    return out


def routed(rows: DataFrame) -> DataFrame:
    """rows(row_id, domain and the fields) to block, row_id, derived, who, day, amount and other, a row for each block that a row goes to. row_id gives the order of the rows."""
    c = F.col
    each = rows.withColumn("block", F.explode(blocks()))
    # Investors among calls: of those without a commitment the first row a name is one.
    known = each.filter("block = 'commitments'").select("investor_name").distinct()
    moved = each.filter("block = 'rerouted'").join(known, "investor_name", "left_anti").groupBy("investor_name").agg(F.min("row_id").alias("row_id"))
    moved = moved.select(F.lit("commitments").alias("block"), "row_id", F.lit(True).alias("derived"), c("investor_name").alias("who"))
    # An exit that is a distribution too has its date, and its proceeds where an amount is missing or zero.
    paid = F.regexp_replace(F.trim("proceeds"), ",", "").try_cast(MONEY)
    projected = (c("block") == "distributions") & ~present("distribution_date") & present("exit_date")
    filled = lambda a: F.when(projected & (F.coalesce(a, F.lit(0)) == 0) & (paid > 0), paid).otherwise(c(a))
    # A valuation without a date has that of its company's last dated investment row.
    company = F.lower(F.trim("company_name"))
    mirror = (c("domain") == "portfolio_investments") & (c("block") == "valuations")
    dates = rows.filter((c("domain") == "portfolio_investments") & present("company_name") & c("fair_value").isNotNull() & c("valuation_date").isNotNull()).groupBy(company.alias("_company")).agg(F.max_by("valuation_date", F.struct("row_id", "valuation_date")).alias("borrowed"))
    # Rows that borrow nothing have a key of their own, so they don't meet in one task.
    borrows = (c("block") == "valuations") & c("valuation_date").isNull()
    each = each.filter("block <> 'rerouted'").withColumn("_company", F.coalesce(F.when(borrows, company), F.concat(F.lit("\0"), c("row_id").cast("string"))))
    each = each.join(few(dates), "_company", "left")
    is_ = lambda *b: c("block").isin(*b)
    who = F.when(is_("capital_calls", "commitments"), c("investor_name")).when(is_("nav_records"), c("period")).when(is_("fund_ledger"), c("description")).otherwise(c("company_name"))
    day = F.when(is_("capital_calls"), c("call_date")).when(is_("distributions"), F.coalesce("distribution_date", "exit_date")).when(is_("exits"), c("exit_date")).when(is_("valuations"), F.coalesce("valuation_date", "borrowed")).when(is_("portfolio_investments"), c("valuation_date"))
    amount = F.when(is_("distributions"), filled("total_gross_amount")).when(is_("exits"), paid).when(is_("valuations"), c("fair_value")).when(is_("portfolio_kpis"), c("arr")).when(is_("portfolio_investments"), c("total_invested")).when(is_("nav_records"), c("total_nav")).when(is_("fund_ledger"), c("net_movement")).when(is_("budget_vs_actual"), c("budget"))
    other = F.when(is_("distributions"), filled("total_net_amount")).when(is_("portfolio_kpis"), c("headcount")).when(is_("budget_vs_actual"), c("actual"))
    out = each.select("block", "row_id", (projected | mirror).alias("derived"), who.alias("who"), day.alias("day"), amount.alias("amount"), other.alias("other"))
    # Lines by period whose name is a net asset value: the first of a period that no record has yet.
    line = F.regexp_replace(F.regexp_replace(F.lower("line_item"), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    lines = rows.filter(c("domain").isin("nav_accounting", "nav_calculation") & line.isin(*NAV_LINES) & present("period") & (c("period_value") != 0))
    had = out.filter("block = 'nav_records' and who is not null").select(c("who").alias("period")).distinct()
    first = lines.groupBy("period").agg(F.min(F.struct("domain", "row_id", "period_value")).alias("x")).join(had, "period", "left_anti")
    more = first.select(F.lit("nav_records").alias("block"), c("x.row_id").alias("row_id"), F.lit(True).alias("derived"), c("period").alias("who"), c("x.period_value").alias("amount"))
    return out.unionByName(moved, allowMissingColumns=True).unionByName(more, allowMissingColumns=True)


def extracted_rows(t) -> DataFrame:
    """Rows of all domains, from receipts: the line's number is its domain, and the part decides which fields it has. Payers with a number divisible by three have a commitment."""
    c, p = F.col, F.col("part_id")
    domain = F.element_at(F.array(*map(F.lit, DOMAINS)), (c("n") % 7 + 1).cast("int"))
    when = lambda cond, x: F.when(cond, x)
    company, period = F.concat(F.lit("Company "), (c("payer_id") % 50).cast("string")), F.concat(F.lit("P"), (p % 40).cast("string"))
    fields = {
        "source_sheet": F.element_at(F.array(F.lit("Exits & Distributions"), F.lit("Realised proceeds"), F.lit("EXITS")), (c("payer_id") % 3 + 1).cast("int")), "investor_name": when(p % 4 != 0, F.concat(F.lit("Payer "), c("payer_id").cast("string"))), "company_name": when(p % 5 != 0, company),
        "call_date": when(p % 3 == 0, c("d")), "call_number": when(p % 5 == 0, F.lit("C1")), "call_ref": when(p % 7 == 0, F.lit("")), "distribution_date": when(p % 3 == 1, c("d")), "exit_date": when(p % 2 == 0, c("d")), "valuation_date": when(p % 4 < 2, c("d")),
        "distribution_number": F.element_at(F.array(F.lit("3"), F.lit("Validation: sum of 12"), F.lit("D-07"), F.lit(None), F.lit("final")), (p % 5 + 1).cast("int")), "period": when(p % 6 != 1, period), "proceeds": when(p % 9 != 0, F.format_number(F.round("net", 2).cast("double"), 2)), "total_gross_amount": F.when(p % 4 == 1, c("gross")).when(p % 8 == 2, 0), "total_net_amount": when(p % 16 == 5, c("net")),
        "fair_value": when(p % 3 == 0, c("gross")), "methodology": when(p % 11 == 0, F.lit("DCF")), "arr": when(p % 4 == 0, c("net")), "headcount": when(p % 10 == 0, c("qty")), "total_nav": when(p % 3 == 0, c("gross")), "description": when(p % 4 == 0, F.lit("cash out")), "net_movement": when(p % 12 == 7, c("net")),
        "line_item": F.when(p % 5 == 1, "Closing Fund NAV").when(p % 5 == 2, "Portfolio Fair Value").when(p % 5 == 3, "- Net NAV -"), "period_value": when(p % 13 != 0, F.when(p % 13 == 1, 0).otherwise(c("net"))), "budget": when(p % 4 == 0, c("gross")), "actual": when(p % 6 == 0, c("net")), "total_invested": c("gross"), "valuer_name": F.lit(None), "kpi_name": F.lit(None), "investments_at_cost": F.lit(None),
    }
    kind = lambda f: "string" if f in TEXTS else "date" if f in DATES else MONEY
    lines = t.recv.select((c("inv_id") * 10 + c("n")).alias("row_id"), domain.alias("domain"), *[v.cast(kind(f)).alias(f) for f, v in fields.items()])
    own = t.supplier.filter("s_suppkey % 3 = 0").select((-c("s_suppkey") - 1).alias("row_id"), F.lit("commitments").alias("domain"), F.concat(F.lit("Payer "), c("s_suppkey").cast("string")).alias("investor_name"))
    return lines.unionByName(own, allowMissingColumns=True)


DOMAINS = ("nav_calculation", "capital_calls", "exits_distributions", "valuations_kpis", "portfolio_investments", "nav_accounting", "financials_pl_bva")
ROUTED = f"""l AS (SELECT *, part_id AS p, inv_id * 10 + n AS row_id, {list(DOMAINS)!r}[n % 7 + 1] AS domain, 'Company ' || payer_id % 50 AS co, 'Payer ' || payer_id AS pa, 'P' || part_id % 40 AS pe, round(net, 2) AS paid, net::DECIMAL(18,4) AS nt, gross::DECIMAL(18,4) AS gr FROM recv),
known AS (SELECT 'Payer ' || s_suppkey AS pa, -s_suppkey - 1 AS row_id FROM supplier WHERE s_suppkey % 3 = 0),
calls AS (SELECT *, p % 3 = 0 OR p % 5 = 0 AS is_call FROM l WHERE domain = 'capital_calls'),
ex AS (SELECT *, p % 2 = 0 AS left_, p % 3 = 1 AS dated, p % 4 = 1 OR p % 8 = 2 OR p % 16 = 5 AS has_amount, CASE WHEN p % 9 <> 0 THEN paid END AS got, CASE WHEN p % 4 = 1 THEN gr WHEN p % 8 = 2 THEN 0 END AS g0, CASE WHEN p % 16 = 5 THEN nt END AS n0 FROM l WHERE domain = 'exits_distributions'),
ds AS (SELECT *, left_ AND NOT dated AS projected FROM ex WHERE CASE WHEN dated THEN true WHEN left_ THEN payer_id % 3 = 0 ELSE has_amount AND (p % 5 IN (0, 2) OR p % 6 <> 1) END),
bor AS (SELECT co, arg_max(d, (row_id, d)) AS day FROM l WHERE domain = 'portfolio_investments' AND p % 5 <> 0 AND p % 3 = 0 AND p % 4 < 2 GROUP BY 1),
va AS (SELECT *, domain = 'portfolio_investments' AS mirror FROM l WHERE domain = 'valuations_kpis' AND (p % 3 = 0 OR p % 11 = 0 OR NOT (p % 4 = 0 OR p % 10 = 0)) OR domain = 'portfolio_investments' AND p % 5 <> 0 AND p % 3 = 0),
nav AS (SELECT *, p % 3 = 0 AS has_nav, p % 4 = 0 OR p % 12 = 7 AS has_ledger FROM l WHERE domain IN ('nav_accounting', 'nav_calculation')),
recs AS (SELECT *, CASE WHEN p % 6 <> 1 THEN pe END AS per FROM nav WHERE has_nav AND (domain = 'nav_calculation' OR NOT has_ledger)),
lin AS (SELECT pe, arg_min(row_id, (domain, row_id, nt)) AS row_id, arg_min(nt, (domain, row_id, nt)) AS v FROM nav WHERE p % 5 IN (1, 3) AND p % 6 <> 1 AND p % 13 > 1 AND nt <> 0 AND pe NOT IN (SELECT per FROM recs WHERE per IS NOT NULL) GROUP BY 1),
o(block, row_id, derived, who, day, amount, other) AS (
  SELECT 'commitments', row_id, false, pa, NULL::DATE, NULL::DECIMAL(18,4), NULL::DECIMAL(18,4) FROM known
  UNION ALL SELECT 'capital_calls', row_id, false, CASE WHEN p % 4 <> 0 THEN pa END, CASE WHEN p % 3 = 0 THEN d END, NULL, NULL FROM calls WHERE is_call
  UNION ALL SELECT 'commitments', min(row_id), true, pa, NULL, NULL, NULL FROM calls WHERE NOT is_call AND p % 4 <> 0 AND pa NOT IN (SELECT pa FROM known) GROUP BY pa
  UNION ALL SELECT 'distributions', row_id, projected, CASE WHEN p % 5 <> 0 THEN co END, d * 1, CASE WHEN projected AND coalesce(g0, 0) = 0 AND got > 0 THEN got ELSE g0 END, CASE WHEN projected AND coalesce(n0, 0) = 0 AND got > 0 THEN got ELSE n0 END FROM (SELECT * REPLACE (CASE WHEN dated OR left_ THEN d END AS d) FROM ds)
  UNION ALL SELECT 'exits', row_id, false, CASE WHEN p % 5 <> 0 THEN co END, d, got, NULL FROM ex WHERE left_
  UNION ALL SELECT 'valuations', row_id, mirror, CASE WHEN p % 5 <> 0 THEN va.co END, coalesce(CASE WHEN p % 4 < 2 THEN d END, CASE WHEN p % 5 <> 0 THEN bor.day END), CASE WHEN p % 3 = 0 THEN gr END, NULL FROM va LEFT JOIN bor USING (co)
  UNION ALL SELECT 'portfolio_kpis', row_id, false, CASE WHEN p % 5 <> 0 THEN co END, NULL, CASE WHEN p % 4 = 0 THEN nt END, CASE WHEN p % 10 = 0 THEN qty END FROM l WHERE domain = 'valuations_kpis' AND (p % 4 = 0 OR p % 10 = 0) OR domain = 'financials_pl_bva' AND NOT (p % 4 = 0 OR p % 6 = 0) AND p % 5 <> 0
  UNION ALL SELECT 'portfolio_investments', row_id, false, CASE WHEN p % 5 <> 0 THEN co END, CASE WHEN p % 4 < 2 THEN d END, gr, NULL FROM l WHERE domain = 'portfolio_investments'
  UNION ALL SELECT 'nav_records', row_id, false, per, NULL, gr, NULL FROM recs UNION ALL SELECT 'nav_records', row_id, true, pe, NULL, v, NULL FROM lin
  UNION ALL SELECT 'fund_ledger', row_id, false, CASE WHEN p % 4 = 0 THEN 'cash out' END, NULL, CASE WHEN p % 12 = 7 THEN nt END, NULL FROM nav WHERE domain = 'nav_accounting' AND (NOT has_nav OR has_ledger)
  UNION ALL SELECT 'budget_vs_actual', row_id, false, CASE WHEN p % 5 <> 0 THEN co END, NULL, CASE WHEN p % 4 = 0 THEN gr END, CASE WHEN p % 6 = 0 THEN nt END FROM l WHERE domain = 'financials_pl_bva' AND (p % 4 = 0 OR p % 6 = 0))"""
ROUTED = ROUTED.replace(", d * 1, CASE WHEN projected", ", d, CASE WHEN projected")


@query("i10_routed_rows", f"WITH {ROUTED} SELECT block, row_id, derived, who, day, amount::DOUBLE AS amount, other::DOUBLE AS other FROM o")
def i10(t):
    """All rows by block, with what was derived and borrowed."""
    return routed(extracted_rows(t)).select("block", "row_id", "derived", "who", "day", dbl("amount").alias("amount"), dbl("other").alias("other"))
