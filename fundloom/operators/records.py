"""Rules over a scheme's records, sheets of cells, and report frames (inventory A, I07, I08, I17, J09, K08, K09, G41, G42)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..sources.tables import AS_OF, dbl
from .fundframe import FRAME, frame, ladder, owners
from .portfolio import KPI, PL, kpi, monthly
from .relational import LATEST_VAL, latest_valuation

# How far a figure may be off before a rule flags it.
RULES = (
    ("multiples", "abs(tvpi - (distributed / called + residual_after_carry / called)) > 0.02"),
    ("fv_column", "distributed / called < 0.5 AND abs((realised + residual) / invested - tvpi) > 0.5"),
    ("committed", "abs(committed - row_cost * 1.3) > 0.01 * committed"),
    ("called", "abs(called - row_cost) > 0.02 * row_cost"),
    ("carry_consistency", "abs(gross_carry - carry_base * 0.2) > 0.5"),
    ("carry_sign", "gross_carry > 0.5 AND distributed + residual <= called"),
    ("carry_net", "abs(net_carry - (gross_carry - paid_carry)) > 0.5"),
    ("company_count", "abs(n_companies - n_named) > greatest(2.0, 0.05 * n_companies)"),
    ("fv_sum", "abs(portfolio_fv - row_fair) > 0.01 * row_fair"),
    ("active_fv_sum", "abs(active_fv - row_fair) > 0.01 * row_fair"),
    ("irr_coverage", "n_without * 2 > n_investments"),
    ("nav_trap", "stated_nav > 1.01 * row_fair"),
    ("nav_walk", "max_mark > 2.5 * median_mark AND n_marks >= 3"),
    ("nav_dates", "n_marks = 0"),
    ("tvpi_sanity", "distributed / called < 0.5 AND tvpi > 2.5"),
    ("carry_base", "abs(carry_base - (distributed + residual - called)) > 0.5"),
    ("valuations_missing", "n_investments > 0 AND portfolio_fv IS NULL"),
    ("distributions", "abs(distributed - ledger) > greatest(0.01 * ledger, 0.5)"),
    ("provenance", "distributed > 0 AND trusted_distributed IS NULL AND ledger = 0"),
    ("compounding_years", "abs(years_expected - years_used) > 0.6"),
    ("terminal_flow", "last_flag <> 'A'"),
    ("nav_across_blocks", "abs(stated_nav - built) > greatest(0.01 * stated_nav, 0.5)"),
)
ROWS = f"""{FRAME}, ri AS (SELECT scheme, sum(i.cost)::DOUBLE AS row_cost, count(*) AS n_investments, count(DISTINCT company_id) AS n_companies, count(*) FILTER (status = 'P') AS n_without, avg(date_diff('day', d, DATE '{AS_OF}')) / 365.25 AS years_expected FROM inv i JOIN co USING (company_id) GROUP BY 1),
rc AS (SELECT scheme, count(*) AS n_named, sum(lv.fair)::DOUBLE * 5000 AS row_fair FROM co LEFT JOIN lv ON holding_id = company_id GROUP BY 1),
rv AS (SELECT scheme, count(*) AS n_marks, max(fair)::DOUBLE AS max_mark, median(fair)::DOUBLE AS median_mark FROM val JOIN co ON company_id = holding_id GROUP BY 1),
rl AS (SELECT scheme, arg_max(flag, (r.d, r.inv_id, n, part_id, payer_id, net)) AS last_flag FROM recv r JOIN inv USING (inv_id) JOIN co USING (company_id) GROUP BY 1),
z AS (SELECT f7.*, last_flag, row_cost, n_investments, n_companies, n_without, years_expected, n_named, row_fair, coalesce(n_marks, 0) AS n_marks, max_mark, median_mark, 5.0 + k % 3 AS years_used FROM f7 JOIN ri USING (scheme) JOIN rc USING (scheme) JOIN rl USING (scheme) LEFT JOIN rv USING (scheme))"""


@query("j09_extraction_rules", f"WITH {ROWS}, u AS ({' UNION ALL '.join(f'''SELECT scheme, '{n}' AS rule, {c} AS flagged FROM z''' for n, c in RULES)}) SELECT scheme, rule, flagged FROM u")
def j09(t):
    """One row a scheme and rule: flagged, not flagged, or null where a figure it needs isn't known."""
    who, c = owners(t).select("company_id", "scheme"), F.col
    i = t.inv.groupBy("company_id").agg(F.sum("cost").alias("cost"), F.count("*").alias("n"), F.count_if(c("status") == "P").alias("p"), F.sum(F.datediff(F.lit(AS_OF).cast("date"), "d")).alias("days")).join(who, "company_id")
    i = i.groupBy("scheme").agg(dbl(F.sum("cost")).alias("row_cost"), F.sum("n").alias("n_investments"), F.count("*").alias("n_companies"), F.sum("p").alias("n_without"), (F.sum("days") / F.sum("n") / 365.25).alias("years_expected"))
    rc = who.join(latest_valuation(t).select(c("holding_id").alias("company_id"), "fair"), "company_id", "left").groupBy("scheme").agg(F.count("*").alias("n_named"), (dbl(F.sum("fair")) * 5000).alias("row_fair"))
    rv = t.val.select(c("holding_id").alias("company_id"), "fair").join(who, "company_id").groupBy("scheme").agg(F.count("*").alias("n_marks"), dbl(F.max("fair")).alias("max_mark"), F.median(dbl("fair")).alias("median_mark"))
    last = t.recv.groupBy("inv_id").agg(F.max(F.struct("d", "inv_id", "n", "part_id", "payer_id", "net", "flag")).alias("x")).join(t.inv.select("inv_id", "company_id"), "inv_id").groupBy("company_id").agg(F.max("x").alias("x"))
    rl = last.join(who, "company_id").groupBy("scheme").agg(F.max("x").alias("x")).select("scheme", c("x.flag").alias("last_flag"))
    z = frame(t).join(i, "scheme").join(rc, "scheme").join(rl, "scheme").join(rv, "scheme", "left").withColumn("n_marks", F.coalesce("n_marks", F.lit(0))).withColumn("years_used", 5.0 + c("k") % 3)
    dpi, off = c("distributed") / c("called"), lambda a, b: F.abs(a - b)
    value = c("distributed") + c("residual")
    # max() over nulls: F.greatest skips them, so it is only used where its sides are known.
    limit = lambda share, x, least: F.when(x.isNotNull(), F.greatest(F.lit(least), x * share))
    flags = {
        "multiples": off(c("tvpi"), dpi + c("residual_after_carry") / c("called")) > 0.02,
        "fv_column": (dpi < 0.5) & (off((c("realised") + c("residual")) / c("invested"), c("tvpi")) > 0.5),
        "committed": off(c("committed"), c("row_cost") * 1.3) > c("committed") * 0.01,
        "called": off(c("called"), c("row_cost")) > c("row_cost") * 0.02,
        "carry_consistency": off(c("gross_carry"), c("carry_base") * 0.2) > 0.5,
        "carry_sign": (c("gross_carry") > 0.5) & (value <= c("called")),
        "carry_net": off(c("net_carry"), c("gross_carry") - c("paid_carry")) > 0.5,
        "company_count": off(c("n_companies"), c("n_named")) > limit(0.05, c("n_companies"), 2.0),
        "fv_sum": off(c("portfolio_fv"), c("row_fair")) > c("row_fair") * 0.01,
        "active_fv_sum": off(c("active_fv"), c("row_fair")) > c("row_fair") * 0.01,
        "irr_coverage": c("n_without") * 2 > c("n_investments"),
        "nav_trap": c("stated_nav") > c("row_fair") * 1.01,
        "nav_walk": (c("max_mark") > c("median_mark") * 2.5) & (c("n_marks") >= 3),
        "nav_dates": c("n_marks") == 0,
        "tvpi_sanity": (dpi < 0.5) & (c("tvpi") > 2.5),
        "carry_base": off(c("carry_base"), value - c("called")) > 0.5,
        "valuations_missing": (c("n_investments") > 0) & c("portfolio_fv").isNull(),
        "distributions": off(c("distributed"), c("ledger")) > limit(0.01, c("ledger"), 0.5),
        "provenance": (c("distributed") > 0) & c("trusted_distributed").isNull() & (c("ledger") == 0),
        "compounding_years": off(c("years_expected"), c("years_used")) > 0.6,
        "terminal_flow": c("last_flag") != "A",
        "nav_across_blocks": off(c("stated_nav"), c("built")) > limit(0.01, c("stated_nav"), 0.5),
    }
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), f.alias("flagged")) for n, f in flags.items()]))
    return z.select("scheme", each.alias("x")).select("scheme", "x.rule", "x.flagged")


ANOMALIES = f"""{PL}, m AS (SELECT *, lag(revenue) OVER (PARTITION BY node ORDER BY period) AS before FROM pl), s AS (SELECT node, avg(revenue) AS mean, stddev_samp(revenue) AS sd, count(*) AS n FROM pl GROUP BY 1)"""


@query("g41_zscore_and_month_anomalies", f"WITH {ANOMALIES} SELECT node, period, 'zscore' AS kind, CASE WHEN abs(revenue - mean) / sd > 3 THEN 'critical' ELSE 'high' END AS severity FROM m JOIN s USING (node) WHERE n >= 3 AND sd > 0 AND abs(revenue - mean) / sd > 2 UNION ALL SELECT node, period, 'month', CASE WHEN (revenue - before) / before * 100 <= -30 THEN 'high' ELSE 'medium' END FROM m WHERE before > 0 AND (revenue - before) / before * 100 <= -20")
def g41(t):
    """Months two sample deviations off the node's mean, and falls of a fifth and more from the month before."""
    c = F.col
    pl = monthly(t)
    s = pl.groupBy("node").agg(F.avg("revenue").alias("mean"), F.stddev_samp("revenue").alias("sd"), F.count("*").alias("n")).filter("n >= 3 and sd > 0")
    z = pl.join(s, "node").withColumn("z", F.abs(c("revenue") - c("mean")) / c("sd")).filter("z > 2")
    m = pl.withColumn("before", F.lag("revenue").over(Window.partitionBy("node").orderBy("period"))).filter("before > 0").withColumn("fall", (c("revenue") - c("before")) / c("before") * 100).filter("fall <= -20")
    told = lambda df, kind, severity: df.select("node", "period", F.lit(kind).alias("kind"), severity.alias("severity"))
    return told(z, "zscore", F.when(c("z") > 3, "critical").otherwise("high")).unionByName(told(m, "month", F.when(c("fall") <= -30, "high").otherwise("medium")))


@query("g42_burn_both_branches", f"WITH {KPI}, k AS (SELECT company_id, arg_max(value, (ts, val_id)) FILTER (slug = 'monthly-burn') AS burn, arg_max(value, (ts, val_id)) FILTER (slug = 'cash-balance') AS cash FROM kpi GROUP BY 1), g AS (SELECT company_id, sum(cost) FILTER (stage = '1-URGENT')::DOUBLE AS opex, sum(cost) FILTER (stage = '2-HIGH')::DOUBLE AS revenue FROM inv GROUP BY 1) SELECT c.company_id, CASE WHEN burn IS NOT NULL THEN 'reported' WHEN opex IS NOT NULL THEN 'derived' ELSE 'unknown' END AS source, round(coalesce(burn, opex), 2) AS gross_burn, round(CASE WHEN burn IS NOT NULL THEN k.cash / nullif(burn, 0) ELSE c.cash::DOUBLE / nullif(opex, 0) END, 4) + 0.0::DOUBLE AS runway, round(CASE WHEN burn IS NOT NULL THEN burn WHEN revenue - opex < 0 THEN opex - revenue ELSE 0 END, 2) AS net_burn FROM company c LEFT JOIN k USING (company_id) LEFT JOIN g USING (company_id)")
def g42(t):
    """What a company reports; else from its budget lines, where a net burn is only a negative result."""
    c, zero = F.col, F.lit(0.0)
    newest = lambda s, name: F.max_by(F.when(c("slug") == s, c("value")), F.when(c("slug") == s, F.struct("ts", "val_id"))).alias(name)
    k = kpi(t).groupBy("company_id").agg(newest("monthly-burn", "burn"), newest("cash-balance", "held"))
    of = lambda s: dbl(F.sum(F.when(c("stage") == s, c("cost"))))
    g = t.inv.groupBy("company_id").agg(of("1-URGENT").alias("opex"), of("2-HIGH").alias("revenue"))
    j = t.company.select("company_id", "cash").join(k, "company_id", "left").join(g, "company_id", "left")
    source = ladder([(c("burn").isNotNull(), F.lit("reported")), (c("opex").isNotNull(), F.lit("derived"))], F.lit("unknown"))
    runway = F.when(c("burn").isNotNull(), F.try_divide("held", F.nullif(c("burn"), zero))).otherwise(F.try_divide(dbl("cash"), F.nullif(c("opex"), zero)))
    net = ladder([(c("burn").isNotNull(), c("burn")), (c("revenue") < c("opex"), c("opex") - c("revenue"))], zero)
    return j.select("company_id", source.alias("source"), F.round(F.coalesce("burn", "opex"), 2).alias("gross_burn"), (F.round(runway, 4) + 0.0).alias("runway"), F.round(net, 2).alias("net_burn"))


# Cells of sheets: each customer's orders are a sheet of text cells, one row an order, in an order of their own.
CELLS = """cells AS (SELECT company_id AS sheet, row_number() OVER (PARTITION BY company_id ORDER BY inv_id) AS r, inv_id, status, stage, cost, d FROM inv)"""


def cells(t) -> DataFrame:
    return t.inv.withColumn("r", F.row_number().over(Window.partitionBy("company_id").orderBy("inv_id"))).withColumnRenamed("company_id", "sheet")  # a sheet is a few rows


@query("i07_layout_dispatch", f"""WITH {CELLS}, l AS (SELECT *, CASE sheet % 4 WHEN 0 THEN 'tabular' WHEN 1 THEN 'key_value' WHEN 2 THEN 'wide_periods' ELSE 'skip' END AS layout FROM cells)
  SELECT sheet, layout, r::INT AS r, 'cost' AS field, cost::VARCHAR AS value FROM l WHERE layout = 'tabular' UNION ALL SELECT sheet, layout, r::INT, 'status', status FROM l WHERE layout = 'tabular'
  UNION ALL SELECT sheet, layout, min(r)::INT, stage, arg_min(cost, r)::VARCHAR FROM l WHERE layout = 'key_value' GROUP BY 1, 2, 4 UNION ALL SELECT sheet, layout, r::INT, strftime(d, '%Y-%m'), cost::VARCHAR FROM l WHERE layout = 'wide_periods' AND cost > 100000""")
def i07(t):
    """Each sheet is read by its layout's own plan; the results are one list of fields. A sheet of no known layout gives none."""
    c = F.col
    layout = ladder([(c("sheet") % 4 == i, F.lit(n)) for i, n in enumerate(("tabular", "key_value", "wide_periods"))], F.lit("skip"))
    rows = cells(t).withColumn("layout", layout)
    of = lambda n: rows.filter(c("layout") == n)
    text = c("cost").cast("string")
    tabular = of("tabular").select("sheet", "layout", "r", F.explode(F.array(F.struct(F.lit("cost").alias("field"), text.alias("value")), F.struct(F.lit("status").alias("field"), c("status").alias("value")))).alias("x")).select("sheet", "layout", "r", "x.*")
    keyed = of("key_value").groupBy("sheet", "layout", c("stage").alias("field")).agg(F.min("r").alias("r"), F.min_by(text, "r").alias("value")).select("sheet", "layout", "r", "field", "value")
    wide = of("wide_periods").filter("cost > 100000").select("sheet", "layout", "r", F.date_format("d", "yyyy-MM").alias("field"), text.alias("value"))
    return tabular.unionByName(keyed).unionByName(wide)


@query("i08_headerless_totals", f"WITH {CELLS} SELECT sheet, sum(cost) FILTER (stage = '1-URGENT')::DOUBLE AS revenue, sum(cost) FILTER (stage = '3-MEDIUM')::DOUBLE AS expenses, (coalesce(sum(cost) FILTER (stage = '1-URGENT'), 0) - coalesce(sum(cost) FILTER (stage = '3-MEDIUM'), 0))::DOUBLE AS result FROM cells WHERE sheet NOT IN (SELECT sheet FROM cells WHERE r = 1 AND status = 'P') GROUP BY 1 HAVING count(*) FILTER (stage IN ('1-URGENT', '3-MEDIUM')) > 0")
def i08(t):
    """Totals by row label of sheets without a header (here: whose first row isn't marked); sheets without any such label have none."""
    c = F.col
    rows = cells(t)
    headed = rows.filter("r = 1 and status = 'P'").select("sheet")
    of = lambda s: F.sum(F.when(c("stage") == s, c("cost")))
    g = rows.join(headed, "sheet", "left_anti").filter(c("stage").isin("1-URGENT", "3-MEDIUM")).groupBy("sheet").agg(of("1-URGENT").alias("a"), of("3-MEDIUM").alias("b"))
    return g.select("sheet", dbl("a").alias("revenue"), dbl("b").alias("expenses"), dbl(F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("result"))


@query("i17_call_amount_ladder", """WITH c AS (SELECT inv_id, max(CASE WHEN n = 1 THEN gross END) AS stated, max(CASE WHEN n = 2 THEN gross END) AS drawn, sum(CASE WHEN n >= 3 THEN gross ELSE 0 END) AS lps FROM (SELECT inv_id, n, CASE WHEN flag = 'R' AND n = 1 THEN 0 ELSE gross END AS gross FROM recv) GROUP BY 1)
  SELECT inv_id, CASE WHEN stated <> 0 THEN stated WHEN drawn <> 0 THEN drawn WHEN lps <> 0 THEN lps END::DOUBLE AS amount, CASE WHEN stated <> 0 THEN 'stated' WHEN drawn <> 0 THEN 'drawn' WHEN lps <> 0 THEN 'sum of lps' ELSE 'none' END AS rung FROM c""")
def i17(t):
    """A call's stated amount, else what was drawn, else the sum of its investors' columns; zero counts as missing."""
    c, zero = F.col, F.lit(0).cast("decimal(18,2)")
    gross = F.when((c("flag") == "R") & (c("n") == 1), zero).otherwise(c("gross"))
    g = t.recv.select("inv_id", "n", gross.alias("gross")).groupBy("inv_id").agg(F.max(F.when(c("n") == 1, c("gross"))).alias("stated"), F.max(F.when(c("n") == 2, c("gross"))).alias("drawn"), F.sum(F.when(c("n") >= 3, c("gross"))).alias("lps"))
    rungs = [(c(x) != 0, dbl(x), name) for x, name in (("stated", "stated"), ("drawn", "drawn"), ("lps", "sum of lps"))]
    return g.select("inv_id", ladder([(x, v) for x, v, _ in rungs], F.lit(None)).alias("amount"), ladder([(x, F.lit(n)) for x, _, n in rungs], F.lit("none")).alias("rung"))


@query("a04_profit_and_loss_sheets", f"""WITH {CELLS}, p AS (SELECT sheet, strftime(d, '%Y-%m') AS period, CASE stage WHEN '1-URGENT' THEN 'revenue' WHEN '2-HIGH' THEN 'cogs' WHEN '3-MEDIUM' THEN 'opex' WHEN '5-LOW' THEN 'one_off' END AS item, cost, r FROM cells),
  w AS (SELECT sheet, period, sum(cost) FILTER (item = 'revenue')::DOUBLE AS revenue, sum(cost) FILTER (item = 'cogs')::DOUBLE AS cogs, sum(cost) FILTER (item = 'opex')::DOUBLE AS opex, sum(cost) FILTER (item = 'one_off')::DOUBLE AS one_off FROM p WHERE item IS NOT NULL GROUP BY 1, 2)
  SELECT sheet, period, round(coalesce(revenue, 0), 2) AS revenue, round(coalesce(revenue, 0) - coalesce(cogs, 0), 2) AS gross_profit, round(coalesce(revenue, 0) - coalesce(cogs, 0) - coalesce(opex, 0) - coalesce(one_off, 0), 2) AS ebitda, round(coalesce(revenue, 0) - coalesce(cogs, 0) - coalesce(opex, 0), 2) AS normalised_ebitda FROM w""")
def a04(t):
    """Labelled rows of a sheet by month: revenue, costs of sales, operating costs and one-offs become the results of the month; rows without a known label are left out, months without a known row too."""
    c, zero = F.col, F.lit(0.0)
    items = {"1-URGENT": "revenue", "2-HIGH": "cogs", "3-MEDIUM": "opex", "5-LOW": "one_off"}
    rows = cells(t).filter(c("stage").isin(*items))
    w = rows.groupBy("sheet", F.date_format("d", "yyyy-MM").alias("period")).agg(*[F.coalesce(dbl(F.sum(F.when(c("stage") == s, c("cost")))), zero).alias(n) for s, n in items.items()])
    gp = c("revenue") - c("cogs")
    return w.select("sheet", "period", F.round("revenue", 2).alias("revenue"), F.round(gp, 2).alias("gross_profit"), F.round(gp - c("opex") - c("one_off"), 2).alias("ebitda"), F.round(gp - c("opex"), 2).alias("normalised_ebitda"))


LAYOUTS = ((0, "revenue", 1), (0, "ebitda", 3), (1, "revenue", 2), (1, "ebitda", 4), (2, "revenue", 3), (3, "revenue", 2), (3, "cash", 5))


@query("a05_fixed_layouts", f"WITH {CELLS}, m(k, field, r) AS (VALUES {', '.join(map(str, LAYOUTS))}) SELECT sheet, field, cost::DOUBLE AS value FROM cells JOIN m ON sheet % 4 = k AND cells.r = m.r")
def a05(t):
    """Four fixed layouts: which row of a company's sheet holds which field is a table."""
    m = t.spark.createDataFrame(LAYOUTS, "k long, field string, r int")
    return cells(t).withColumn("k", F.col("sheet") % 4).join(F.broadcast(m), ["k", "r"]).select("sheet", "field", dbl("cost").alias("value"))  # seven rows


@query("a07_sections", f"WITH {CELLS}, s AS (SELECT *, sum(CASE WHEN status = 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY sheet ORDER BY r) AS section FROM cells) SELECT sheet, section::INT AS section, count(*) FILTER (status <> 'P') AS n_rows, coalesce(sum(cost) FILTER (status <> 'P'), 0)::DOUBLE AS total FROM s WHERE section > 0 GROUP BY 1, 2")
def a07(t):
    """A section begins at its title (here: a row marked P) and ends at the next; rows before the first title belong to none."""
    c = F.col
    s = cells(t).withColumn("section", F.sum(F.when(c("status") == "P", 1).otherwise(0)).over(Window.partitionBy("sheet").orderBy("r")))
    own = c("status") != "P"
    return s.filter("section > 0").groupBy("sheet", c("section").cast("int").alias("section")).agg(F.count_if(own).alias("n_rows"), F.coalesce(dbl(F.sum(F.when(own, c("cost")))), F.lit(0.0)).alias("total"))


@query("a08_workbook_sections", f"WITH {CELLS}, s AS (SELECT *, sum(CASE WHEN status = 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY sheet ORDER BY r) AS section FROM cells), k AS (SELECT *, CASE section % 3 WHEN 1 THEN 'investments' WHEN 2 THEN 'valuations' ELSE 'exits' END AS block FROM s WHERE section > 0 AND status <> 'P') SELECT block, sheet, inv_id, d, cost::DOUBLE AS amount, NOT (cost <= 0) AS usable FROM k")
def a08(t):
    """The rows of all sections, each in the block that its section stands for."""
    c = F.col
    s = cells(t).withColumn("section", F.sum(F.when(c("status") == "P", 1).otherwise(0)).over(Window.partitionBy("sheet").orderBy("r"))).filter("section > 0 and status <> 'P'")
    block = ladder([(c("section") % 3 == 1, F.lit("investments")), (c("section") % 3 == 2, F.lit("valuations"))], F.lit("exits"))
    return s.select(block.alias("block"), "sheet", "inv_id", "d", dbl("cost").alias("amount"), (~(c("cost") <= 0)).alias("usable"))


@query("a09_json_documents", "SELECT val_id, CASE WHEN val_id % 7 = 0 THEN NULL ELSE (props->>'$.k')::BIGINT END AS k, CASE WHEN val_id % 7 = 0 THEN NULL ELSE fair END AS fair, CASE WHEN val_id % 7 = 0 THEN 'broken' ELSE 'read' END AS state FROM (SELECT event_id AS val_id, props, value AS fair FROM events)")
def a09(t):
    """Documents with a schema; one that isn't valid is told, not dropped."""
    e = t.events.select(F.col("event_id").alias("val_id"), F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("value").alias("fair"))).alias("doc"))
    e = e.withColumn("doc", F.when(F.col("val_id") % 7 == 0, F.expr("left(doc, length(doc) - 3)")).otherwise(F.col("doc")))
    read = F.from_json("doc", "k long, fair double, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return e.select("val_id", read.alias("x")).select("val_id", F.when(F.col("x._bad").isNull(), F.col("x.k")).alias("k"), F.when(F.col("x._bad").isNull(), F.col("x.fair")).alias("fair"), F.when(F.col("x._bad").isNull(), "read").otherwise("broken").alias("state"))


@query("a10_hierarchy", "SELECT DISTINCT r_name AS fund, r_name || '::' || n_name AS node_id, r_name AS parent_id, 2 AS level FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, r_name, NULL, 1 FROM region UNION ALL SELECT DISTINCT fund, fund || '::' || sector || '::' || segment, fund || '::' || sector, 3 FROM company")
def a10(t):
    """The registry as nodes with parents: funds, sectors, segments."""
    fund = t.region.select(F.col("r_name").alias("fund"), F.col("r_name").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(1).alias("level"))
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    sector = named.select(F.col("r_name").alias("fund"), F.concat_ws("::", "r_name", "n_name").alias("node_id"), F.col("r_name").alias("parent_id"), F.lit(2).alias("level"))
    seg = t.company.select("fund", "sector", "segment").distinct().select("fund", F.concat_ws("::", "fund", "sector", "segment").alias("node_id"), F.concat_ws("::", "fund", "sector").alias("parent_id"), F.lit(3).alias("level"))
    return fund.unionByName(sector).unionByName(seg)


RATES = (("1995-01-01", "INR", 32.0), ("1997-01-01", "INR", 36.0), ("1999-06-01", "INR", 43.0), ("2000-01-01", "EUR", 1.0), ("1996-01-01", "EUR", 0.9))


@query("a12_dated_rates", f"WITH r(day, cur, rate) AS (VALUES {', '.join(f'(DATE {d!r}, {c!r}, {x}::DOUBLE)' for d, c, x in RATES)}), i AS (SELECT inv_id, d, cost, ['INR', 'EUR', 'USD'][inv_id % 3 + 1] AS cur FROM inv) SELECT i.inv_id, i.cur, round(i.cost::DOUBLE / CASE WHEN i.cur = 'USD' THEN 1 ELSE arg_max(rate, day) END, 3) AS usd FROM i LEFT JOIN r ON r.cur = i.cur AND day <= d GROUP BY i.inv_id, i.cur, i.cost")
def a12(t):
    """The rate of the day or the newest before it; none before the first rate of a currency."""
    r = t.spark.createDataFrame(RATES, "day string, cur string, rate double").groupBy("cur").agg(F.array_sort(F.collect_list(F.struct(F.col("day").cast("date").alias("day"), "rate"))).alias("rates"))  # five rows
    i = t.inv.select("inv_id", "d", "cost", F.element_at(F.array(*map(F.lit, ("INR", "EUR", "USD"))), (F.col("inv_id") % 3 + 1).cast("int")).alias("cur")).join(F.broadcast(r), "cur", "left")
    known = F.filter("rates", lambda x: x["day"] <= F.col("d"))
    rate = F.when(F.col("cur") == "USD", 1.0).otherwise(F.try_element_at(known, F.lit(-1))["rate"])
    return i.select("inv_id", "cur", F.round(F.try_divide(dbl("cost"), rate), 3).alias("usd"))


@query("a16_replace_scheme_metrics", f"WITH {FRAME}, old AS (SELECT scheme, m.metric, m.value FROM f7, (VALUES ('dpi', 1.0::DOUBLE), ('gone', 2.0)) m(metric, value)), new AS (SELECT scheme, 'dpi' AS metric, round(distributed / called, 4) AS value FROM f7 WHERE k % 3 = 0) SELECT * FROM new UNION ALL SELECT * FROM old WHERE scheme NOT IN (SELECT scheme FROM new)")
def a16(t):
    """Metrics of a scheme are replaced in whole: those that are no longer computed go too. Schemes without new ones keep theirs."""
    f = frame(t).select("scheme", "k", F.round(F.col("distributed") / F.col("called"), 4).alias("dpi"))
    old = f.select("scheme", F.explode(F.array(F.struct(F.lit("dpi").alias("metric"), F.lit(1.0).alias("value")), F.struct(F.lit("gone").alias("metric"), F.lit(2.0).alias("value")))).alias("x")).select("scheme", "x.*")
    new = f.filter("k % 3 = 0").select("scheme", F.lit("dpi").alias("metric"), F.col("dpi").alias("value"))
    return new.unionByName(old.join(new.select("scheme").distinct(), "scheme", "left_anti"))


@query("a19_csv_lines", "SELECT company_id, '\"' || replace(company, '\"', '\"\"') || '\",' || sector || ',' || CASE WHEN company_id % 9 = 0 THEN '\"a,\"\"b\"\"\"' ELSE 'plain' END || ',' || cash::VARCHAR AS line FROM company")
def a19(t):
    """Rows as the lines of a CSV file: a field with a separator or a quote is quoted, its quotes doubled; names always are."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    note = F.when(F.col("company_id") % 9 == 0, F.lit('a,"b"')).otherwise(F.lit("plain"))
    safe = F.when(note.rlike('[",\n]'), quoted(note)).otherwise(note)
    return t.company.select("company_id", F.concat_ws(",", quoted(F.col("company")), "sector", safe, F.col("cash").cast("string")).alias("line"))


@query("a20_tree_snapshot", f"WITH {LATEST_VAL} SELECT sha256(fund || '{AS_OF}') AS snapshot_id, fund || '::' || sector AS node_id, fund AS parent_id, count(*) AS companies, coalesce(sum(lv.fv), 0)::DOUBLE AS fv FROM company LEFT JOIN lv ON holding_id = company_id GROUP BY fund, sector")
def a20(t):
    """The rows that a snapshot of the tree is written as: one a node, under the snapshot's id."""
    lv = latest_valuation(t).select(F.col("holding_id").alias("company_id"), "fv")
    g = t.company.join(lv, "company_id", "left").groupBy("fund", "sector").agg(F.count("*").alias("companies"), F.sum("fv").alias("fv"))
    return g.select(F.sha2(F.concat("fund", F.lit(AS_OF)), 256).alias("snapshot_id"), F.concat_ws("::", "fund", "sector").alias("node_id"), F.col("fund").alias("parent_id"), "companies", F.coalesce(dbl("fv"), F.lit(0.0)).alias("fv"))


NUMBERS = ("1,234.50", "₹ 12", " $7 ", "N/A", "-5%", "12 Cr", "(3)", "", None, "1e3")


@query("h02_plain_numbers", "WITH x(i, s) AS (VALUES (0, '1,234.50'), (1, '₹ 12'), (2, ' $7 '), (3, 'N/A'), (4, '-5%'), (5, '12 Cr'), (6, '(3)'), (7, ''), (8, NULL), (9, '1e3')) SELECT val_id, try_cast(regexp_replace(s, '[,₹$% ]', '', 'g') AS DOUBLE) AS value FROM val JOIN x ON val_id % 10 = i")
def h02(t):
    """Symbols, blanks and commas go; what is left is a number or null. Brackets and unit words aren't understood here."""
    s = F.element_at(F.array(*map(F.lit, NUMBERS)), (F.col("val_id") % 10 + 1).cast("int"))
    return t.val.select("val_id", F.regexp_replace(s, "[,₹$% ]", "").try_cast("double").alias("value"))


LABELLED = ("FY 2024-25", "FY2023-2024", "Q1 FY25", "q3 FY2026", "Mar-25", "sep 2024", "2025-03-31", "31/12/2024", "what", "")


@query("h05_period_parts", "WITH x(i, y, t, m, q) AS (VALUES (0, 2025, 'annual', NULL, NULL), (1, 2024, 'annual', NULL, NULL), (2, 2025, 'quarterly', NULL, 'Q1'), (3, 2026, 'quarterly', NULL, 'Q3'), (4, 2025, 'monthly', 3, NULL), (5, 2024, 'monthly', 9, NULL), (6, 2025, 'monthly', 3, NULL), (7, 2024, 'monthly', 12, NULL), (8, NULL, NULL, NULL, NULL), (9, NULL, NULL, NULL, NULL)) SELECT val_id, y AS period_year, t AS period_type, m AS period_month, q AS period_quarter FROM val JOIN x ON val_id % 10 = i")
def h05(t):
    """Year, kind, month and quarter of a label; a fiscal year is named by its end, and so are its quarters."""
    s = F.upper(F.element_at(F.array(*map(F.lit, LABELLED)), (F.col("val_id") % 10 + 1).cast("int")))
    whole = lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y).try_cast("int")
    part = lambda rx, i: F.regexp_extract(s, rx, i)
    fy, quarter, month = r"^FY\s*\d{2,4}\s*-\s*(\d{2,4})$", r"^(Q[1-4])\s*FY\s*(\d{2,4})$", r"^([A-Z]{3})[ -](\d{2,4})$"
    number = F.array_position(F.array(*map(F.lit, "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split())), part(month, 1)).cast("int")
    day = F.coalesce(F.try_to_date(s, "yyyy-MM-dd"), F.try_to_date(s, "dd/MM/yyyy"))
    is_month = s.rlike(month) & (number > 0)
    rungs = [(s.rlike(fy), "annual", whole(part(fy, 1)), None, None), (s.rlike(quarter), "quarterly", whole(part(quarter, 2)), None, part(quarter, 1)), (is_month, "monthly", whole(part(month, 2)), number, None), (day.isNotNull(), "monthly", F.year(day), F.month(day), None)]
    none = F.lit(None)
    pick = lambda i, kind: ladder([(r[0], F.lit(r[i]) if r[i] is None or isinstance(r[i], str) else r[i]) for r in rungs], none).cast(kind)
    return t.val.select("val_id", pick(2, "int").alias("period_year"), pick(1, "string").alias("period_type"), pick(3, "int").alias("period_month"), pick(4, "string").alias("period_quarter"))


ALIASES = ("Fair_Value (INR)", "fair-value inr", "Co. Name", "co_name", "  Call   Date ", "NAV/Unit")


@query("h11_alias_forms", "WITH x(i, sp, co) AS (VALUES (0, 'fair value inr', 'fairvalueinr'), (1, 'fair value inr', 'fairvalueinr'), (2, 'co name', 'coname'), (3, 'co name', 'coname'), (4, 'call date', 'calldate'), (5, 'nav unit', 'navunit')) SELECT val_id, sp AS spaced, co AS compact FROM val JOIN x ON val_id % 6 = i")
def h11(t):
    """Two forms of a header: words with single blanks, and without any."""
    s = F.element_at(F.array(*map(F.lit, ALIASES)), (F.col("val_id") % 6 + 1).cast("int"))
    spaced = F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    return t.val.select("val_id", spaced.alias("spaced"), F.replace(spaced, F.lit(" "), F.lit("")).alias("compact"))


#: What the end or a part of a field's name says about its values; the first that fits counts.
KINDS = (("_date", "date"), ("_pct", "percent"), ("is_", "flag"), ("amount", "number"), ("value", "number"))
FIELDS = ("call_date", "holding_pct", "is_active", "call_amount", "fair_value", "company_name", "value_date")


CELLS_OF_FIELDS = f"""CASE val_id % {len(FIELDS)} WHEN 0 THEN strftime(d, '%d/%m/%Y') WHEN 1 THEN CASE WHEN val_id % 4 = 0 THEN (val_id % 90 + 1) || '%' ELSE '0.' || (10 + val_id % 90) END WHEN 2 THEN ['Yes', 'no', 'maybe', ' TRUE '][val_id % 4 + 1] WHEN 3 THEN '1,' || (100 + val_id % 900) WHEN 4 THEN '(' || val_id || '.50)' WHEN 5 THEN methodology ELSE strftime(d, '%Y-%m-%d') END"""


@query("h15_kind_by_name", f"""WITH f AS (SELECT val_id, ({list(FIELDS)!r})[val_id % {len(FIELDS)} + 1] AS field, {CELLS_OF_FIELDS} AS raw FROM val),
  k AS (SELECT *, CASE WHEN contains(field, '_date') THEN 'date' WHEN contains(field, '_pct') THEN 'percent' WHEN starts_with(field, 'is_') THEN 'flag' WHEN contains(field, 'amount') OR contains(field, 'value') THEN 'number' ELSE 'text' END AS kind FROM f),
  n AS (SELECT *, CASE WHEN raw LIKE '(%' THEN -1 ELSE 1 END * try_cast(regexp_replace(raw, '[,()%]', '', 'g') AS DOUBLE) AS x FROM k)
  SELECT val_id, field, kind, CASE WHEN kind = 'date' THEN coalesce(try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%d/%m/%Y'))::DATE END AS day, CASE kind WHEN 'number' THEN x WHEN 'percent' THEN round(CASE WHEN x > 0 AND x < 0.5 THEN x * 100 ELSE x END, 6) END AS number,
  CASE WHEN kind = 'flag' THEN CASE lower(trim(raw)) WHEN 'yes' THEN true WHEN 'true' THEN true WHEN 'no' THEN false END END AS flag, CASE WHEN kind = 'text' THEN raw END AS text FROM n""")
def h15(t):
    """A field's name says how its cells are read: as dates, percents, flags, numbers or texts. Every reading is a cell of one of seven fields."""
    c, i = F.col, F.col("val_id")
    pick = lambda of, k: F.element_at(F.array(*map(F.lit, of)), (k + 1).cast("int"))
    text = lambda x: x.cast("string")
    share = F.when(i % 4 == 0, F.concat(text(i % 90 + 1), F.lit("%"))).otherwise(F.concat(F.lit("0."), text(i % 90 + 10)))
    raws = [F.date_format("d", "dd/MM/yyyy"), share, pick(("Yes", "no", "maybe", " TRUE "), i % 4), F.concat(F.lit("1,"), text(i % 900 + 100)), F.concat(F.lit("("), text(i), F.lit(".50)")), c("methodology"), F.date_format("d", "yyyy-MM-dd")]
    f = t.val.select("val_id", pick(FIELDS, i % len(FIELDS)).alias("field"), ladder([(i % len(FIELDS) == k, x) for k, x in enumerate(raws)], F.lit(None)).alias("raw"))
    fits = lambda key: c("field").startswith(key) if key.endswith("_") else c("field").contains(key)
    f = f.withColumn("kind", ladder([(fits(k), F.lit(v)) for k, v in KINDS], F.lit("text")))
    number = ladder([(c("kind") == "number", T.number(c("raw"))), (c("kind") == "percent", F.round(T.as_percent(T.number(c("raw"))), 6))], F.lit(None))
    return f.select("val_id", "field", "kind", F.when(c("kind") == "date", T.date(c("raw"))).alias("day"), number.alias("number"), F.when(c("kind") == "flag", T.truth(c("raw"))).alias("flag"), F.when(c("kind") == "text", c("raw")).alias("text"))
