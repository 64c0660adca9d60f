"""What a workbook's sheets are about, and a portfolio company's monthly workbook (inventory A04 and I12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import dbl
from .sheets import SHEETS, investment_grid

# The phrases that tell a sheet's domain, in order of precedence; the layer that each domain belongs to; what looks like a date in a header.
ANCHORS = (
    ("waterfall_carry", ("waterfall", "carried interest", "carry schedule", "gp economics", "distribution waterfall", "hurdle", "clawback", "catch-up", "catchup")),
    ("nav_calculation", ("nav computation", "nav calc", "nav build", "nav buildup", "closing nav per unit")),
    ("nav_accounting", ("nav workings", "nav record", "nav walk", "nav history", "nav by period", "monthly nav", "quarterly nav", "fund accounting", "nav & accounting", "nav and accounting", "nav accounting", "nav statement")),
    ("exits", ("exit register", "exit event", "realisation", "realization", "exit summary", "exit ipo", "realised proceeds", "realized proceeds")),
    ("distributions", ("distribution schedule", "distribution register", "lp distribution", "distribution to lp", "distributions")),
    ("quoted_unquoted", ("quoted", "unquoted", "listed share", "unlisted share", "ipev level")),
    ("valuations_kpis", ("valuation", "fmv", "fair value of holding", "ipev", "price book")),
    ("portfolio_investments", ("portfolio investment", "portfolio companies", "investee", "investments register", "investment register", "portfolio register", "portfolio summary", "cost & fmv", "company master")),
    ("portfolio_hierarchy", ("portfolio hierarchy", "portfolio tree", "sector segment", "fund hierarchy")),
    ("capital_calls", ("capital call", "drawdown notice", "drawdown schedule", "call notice")),
    ("commitments", ("commitment register", "lp commitment", "commitment schedule", "lp register", "investor register", "lp commitments")),
    ("investors_aml", ("investor master", "lp master", "aml", "kyc", "investor list", "limited partner")),
    ("lp_capital_accounts", ("capital account", "lp account", "partner account", "lp statement", "lp ledger")),
    ("fees_register", ("fee schedule", "fee register", "management fee", "mgmt fee", "gst on fee")),
    ("compliance", ("compliance", "sebi report", "sebi filing", "qar", "aar", "compliance calendar", "ppm amendment", "compliance test")),
    ("burn_runway", ("burn", "runway", "cash burn", "mrr", "arr", "saas metric", "churn", "nrr", "arpu", "ltv/cac")),
    ("financials_pl_bva", ("monthly p&l", "monthly pl", "monthly p & l", "company p&l", "company pl", "budget vs actual", "budget v actual", "monthly mis", "quarterly mis", "balance sheet", "cash flow", "profit & loss", "profit and loss", "portfolio financials", "company financials")),
    ("fund_pl_bs", ("fund p&l", "fund pl", "fund balance sheet", "fund financials", "fund-level p&l", "fund-level pl", "consolidated p&l")),
    ("fund_scheme_master", ("fund master", "scheme master", "fund overview", "cover", "fund identity", "fund details", "scheme details", "lpa terms", "fund summary")),
    ("organization_users", ("organization", "org master", "user master", "gp user")),
    ("entities", ("service entities", "sponsor", "trustee", "custodian", "auditor entity")),
)
LAYERS = {"portfolio_investments": "L2", "valuations_kpis": "L2", "quoted_unquoted": "L2", "portfolio_hierarchy": "L2", "exits": "L2", "financials_pl_bva": "L3", "burn_runway": "L3", "kpi_matrix": "L3"}
BY_TIME = ("financials_pl_bva", "burn_runway", "kpi_matrix", "fund_pl_bs", "unknown")
DATE_IN_HEADER = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec|q[1-4]|fy\s?\d{2,4}|\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})\b"
#: Rows whose cells count as header, date-like tokens and rows that make a time series.
HEADER_ROWS, TOKENS, LEAST_ROWS = 12, 3, 10


def normal(x: Column) -> Column:
    return F.translate(F.lower(F.trim(x)), "_-.", "   ")


def anchor_rows(spark) -> DataFrame:
    """rank, domain and anchor: the phrases as a table."""
    return spark.createDataFrame([(i, d, a) for i, (d, anchors) in enumerate(ANCHORS) for a in anchors], "rank int, domain string, anchor string")


def classified(names: DataFrame, grid: DataFrame, anchors: DataFrame) -> DataFrame:
    """names(sheet, name), grid and anchors to sheet, domain, layer, date_hits, n_rows and time_series.

    A phrase in the sheet's name decides before any in its header, and of several domains the first. Dates in the header only hint: a sheet with dates and rows enough goes to the layer of time series if its domain is one of those or unknown.
    """
    c = F.col
    listed = [tuple(r) for r in anchors.collect()]  # a few hundred phrases
    known = F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(d).alias("domain"), F.lit(a).alias("anchor")) for r, d, a in listed])
    first = lambda text: F.array_min(F.transform(F.filter(known, lambda a: text.contains(a["anchor"])), lambda a: F.struct(a["rank"].alias("rank"), a["domain"].alias("domain"))))
    head = grid.filter(c("row") < HEADER_ROWS).withColumn("text", normal(c("raw")))
    by_text = head.select("text").distinct().select("text", first(c("text")).alias("hit"), F.regexp_count("text", F.lit(DATE_IN_HEADER)).alias("dates"))
    of = head.join(by_text, "text").groupBy("sheet").agg(F.min("hit").alias("hit"), F.sum("dates").cast("long").alias("date_hits"))
    size = grid.groupBy("sheet").agg((F.max("row") + 1).alias("n_rows"))
    out = names.select("sheet", first(normal(c("name"))).alias("named")).join(of, "sheet", "left").join(size, "sheet", "left")
    out = out.select("sheet", F.coalesce("named.domain", "hit.domain", F.lit("unknown")).alias("domain"), F.coalesce("date_hits", F.lit(0)).alias("date_hits"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
    series = (c("date_hits") >= TOKENS) & (c("n_rows") >= LEAST_ROWS)
    layers = F.create_map(*[F.lit(x) for kv in LAYERS.items() for x in kv])
    layer = F.when(series & c("domain").isin(*BY_TIME), "L3").otherwise(F.coalesce(F.try_element_at(layers, c("domain")), F.lit("L1")))
    return out.select("sheet", "domain", layer.alias("layer"), "date_hits", "n_rows", series.alias("time_series"))


NAMES = ("Portfolio_Companies", "NAV-Workings 2024", "Sheet1", "Capital.Call notices", "Carry Schedule & Portfolio Summary", "Data", "Fund P&L", "Notes", "Monthly P & L", "Quoted vs Valuation", "Summary of Realised Proceeds", "x")
MARKS = ("Closing NAV per unit", "Management Fee", "no phrase", "LTV/CAC", "Balance-Sheet Q1", "Mgmt_Fee FY24 Apr May")


def workbook(t) -> tuple[DataFrame, DataFrame]:
    """The investment sheets with a name each, and on some a phrase beside the header; of the sheets with a number divisible by five only the phrase is left."""
    c = F.col
    pick = lambda of, k: F.element_at(F.array(*map(F.lit, of)), (k + 1).cast("int"))
    ids = t.inv.select(c("company_id").alias("sheet")).distinct()
    grid = investment_grid(t).filter("sheet % 5 <> 0").select("sheet", "row", "raw").unionByName(ids.filter("sheet % 3 <> 1").select("sheet", (c("sheet") % 14).alias("row"), pick(MARKS, c("sheet") % len(MARKS)).alias("raw")))
    return ids.select("sheet", pick(NAMES, c("sheet") % len(NAMES)).alias("name")), grid


FLAT = [(i, d, a) for i, (d, anchors) in enumerate(ANCHORS) for a in anchors]
NORMAL = "translate(lower(trim({x})), '_-.', '   ')"


@query("i12_sheet_domains", f"""WITH {SHEETS}, ids AS (SELECT DISTINCT sheet FROM cells), an(rank, domain, anchor) AS (VALUES {', '.join(map(str, FLAT))}), ly(domain, layer) AS (VALUES {', '.join(map(str, LAYERS.items()))}),
  gg AS (SELECT sheet, row, raw FROM g WHERE sheet % 5 <> 0 UNION ALL SELECT sheet, sheet % 14, ({list(MARKS)!r})[(sheet % {len(MARKS)} + 1)::INT] FROM ids WHERE sheet % 3 <> 1),
  tx AS (SELECT sheet, {NORMAL.format(x='raw')} AS text FROM gg WHERE row < {HEADER_ROWS}), dt AS (SELECT DISTINCT text FROM tx), ht AS (SELECT text, min(rank) AS rank FROM dt JOIN an ON contains(text, anchor) GROUP BY 1), hr AS (SELECT sheet, min(rank) AS rank FROM tx JOIN ht USING (text) GROUP BY 1),
  dh AS (SELECT sheet, sum(len(regexp_extract_all(text, '{DATE_IN_HEADER}'))) AS hits FROM tx GROUP BY 1), sz AS (SELECT sheet, max(row) + 1 AS n_rows FROM gg GROUP BY 1),
  nr AS (SELECT sheet, min(rank) AS rank FROM (SELECT sheet, {NORMAL.format(x=f"({list(NAMES)!r})[(sheet % {len(NAMES)} + 1)::INT]")} AS name FROM ids) JOIN an ON contains(name, anchor) GROUP BY 1),
  o AS (SELECT ids.sheet, coalesce(d.domain, 'unknown') AS domain, coalesce(hits, 0)::BIGINT AS date_hits, coalesce(n_rows, 0) AS n_rows FROM ids LEFT JOIN nr USING (sheet) LEFT JOIN hr USING (sheet) LEFT JOIN dh USING (sheet) LEFT JOIN sz USING (sheet) LEFT JOIN (SELECT DISTINCT rank, domain FROM an) d ON d.rank = coalesce(nr.rank, hr.rank))
  SELECT sheet, o.domain, CASE WHEN date_hits >= {TOKENS} AND n_rows >= {LEAST_ROWS} AND o.domain IN {BY_TIME!r} THEN 'L3' ELSE coalesce(layer, 'L1') END AS layer, date_hits, n_rows, date_hits >= {TOKENS} AND n_rows >= {LEAST_ROWS} AS time_series FROM o LEFT JOIN ly ON ly.domain = o.domain""")
def i12(t):
    """Each sheet's domain and layer."""
    return classified(*workbook(t), anchor_rows(t.spark))


# A company's monthly workbook: two sheets of results that overlap, working capital and segments, all made of its investments.
FIRST, LAST, CLOSED = 1996, 2001, 5
BUCKETS = {"1-URGENT": "revenue", "2-HIGH": "cogs", "3-MEDIUM": "opex", "5-LOW": "one_off"}
LABELS = {"AR": "ar", "DSO": "dso", "Inventory": "inventory", "AP": "ap", "NWC": "nwc"}
WRITTEN = ("AR", " DSO", "Inventory ", "AP", "check", "NWC")


def long(df: DataFrame, block: str, key: Column, values: list[str]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("field"), F.round(F.col(v).cast("double"), 4).alias("value")) for v in values]))
    return df.select("company_id", F.lit(block).alias("block"), key.alias("key"), each.alias("x")).select("company_id", "block", "key", "x.field", "x.value")


def monthly_results(cells: DataFrame) -> DataFrame:
    """cells(company_id, sheet, month, bucket, value) to the months' results: a month without any is left out, and of two sheets that have it the last one counts."""
    c = F.col
    of = [F.coalesce(F.sum(F.when(c("bucket") == b, c("value"))), F.lit(0)).alias(b) for b in BUCKETS.values()]
    m = cells.groupBy("company_id", "sheet", "month").agg(*of).filter("revenue <> 0 or cogs <> 0 or opex <> 0")
    m = m.groupBy("company_id", "month").agg(F.max_by(F.struct(*BUCKETS.values()), "sheet").alias("x")).select("company_id", "month", "x.*")
    gross = c("revenue") - c("cogs")
    ebitda = gross - c("opex")
    return m.select("company_id", "month", "revenue", "cogs", gross.alias("gross_profit"), F.coalesce(F.round(F.try_divide(dbl(gross), F.nullif(dbl("revenue"), F.lit(0.0))) * 100, 2), F.lit(0.0)).alias("gp_pct"), "opex", ebitda.alias("ebitda"), (ebitda + c("one_off")).alias("normalized_ebitda"))


def labelled(cells: DataFrame, labels: dict[str, str], least: int) -> DataFrame:
    """cells(company_id, month, label, value, at) to a row a month with the known labels' last numbers; months with fewer of them are left out."""
    c = F.col
    named = cells.withColumn("label", F.trim("label")).filter(c("label").isin(*labels) & c("value").isNotNull())
    out = named.groupBy("company_id", "month").agg(*[F.max_by(F.when(c("label") == k, c("value")), F.when(c("label") == k, c("at"))).alias(v) for k, v in labels.items()])
    return out.filter(sum((c(v).isNotNull().cast("int") for v in labels.values()), F.lit(0)) >= least)


@query("a04_company_workbook", f"""WITH v AS (SELECT company_id, inv_id, inv_id % 2 AS sheet, strftime(d, '%Y-%m') AS month, year(d) AS y, month(d) AS m, stage, CASE WHEN inv_id % 6 = 5 THEN 0 ELSE cost END AS value, ({list(WRITTEN)!r})[(inv_id // 2 % 6 + 1)::INT] AS label FROM inv),
  p AS (SELECT company_id, sheet, month, {', '.join(f"coalesce(sum(value) FILTER (stage = '{s}'), 0) AS {b}" for s, b in BUCKETS.items())} FROM v WHERE y >= {FIRST} AND stage IN {tuple(BUCKETS)!r} GROUP BY 1, 2, 3),
  q AS (SELECT * FROM p WHERE revenue <> 0 OR cogs <> 0 OR opex <> 0 QUALIFY row_number() OVER (PARTITION BY company_id, month ORDER BY sheet DESC) = 1),
  r AS (SELECT *, revenue - cogs AS gross_profit, revenue - cogs - opex AS ebitda, revenue - cogs - opex + one_off AS normalized_ebitda, coalesce(round((revenue - cogs)::DOUBLE / nullif(revenue, 0)::DOUBLE * 100, 2), 0) AS gp_pct FROM q),
  w AS (SELECT company_id, month, {', '.join(f"arg_max(value, inv_id) FILTER (trim(label) = '{k}')::DOUBLE AS {f}" for k, f in LABELS.items())} FROM v WHERE inv_id % 11 <> 0 GROUP BY 1, 2),
  s AS (SELECT company_id, stage, sum(value) FILTER (y = {LAST - 1}) AS before, sum(value) FILTER (y = {LAST}) AS now FROM v WHERE y IN ({LAST - 1}, {LAST}) AND m <= {CLOSED} GROUP BY 1, 2)
  {' UNION ALL '.join(f"SELECT company_id, 'monthly_pl' AS block, month AS key, '{f}' AS field, round({f}::DOUBLE, 4) AS value FROM r" for f in ('revenue', 'cogs', 'gross_profit', 'gp_pct', 'opex', 'ebitda', 'normalized_ebitda'))}
  UNION ALL {' UNION ALL '.join(f"SELECT company_id, 'working_capital', month, '{f}', round({f}, 4) FROM w WHERE {' + '.join(f'({x} IS NOT NULL)::INT' for x in LABELS.values())} >= 2" for f in LABELS.values())}
  UNION ALL {' UNION ALL '.join(f"SELECT company_id, 'segments', stage, '{f}', round(({x})::DOUBLE, 4) FROM s" for f, x in (('ytd_before', 'before'), ('ytd_now', 'now'), ('yoy_ratio', 'now::DOUBLE / nullif(before, 0)::DOUBLE - 1')))}""")
def a04(t):
    """The blocks of each company's workbook as one list."""
    c = F.col
    value = F.when(c("inv_id") % 6 == 5, F.lit(0)).otherwise(c("cost"))
    label = F.element_at(F.array(*map(F.lit, WRITTEN)), (F.floor(c("inv_id") / 2) % 6 + 1).cast("int"))
    v = t.inv.select("company_id", "inv_id", (c("inv_id") % 2).alias("sheet"), F.date_format("d", "yyyy-MM").alias("month"), F.year("d").alias("y"), F.month("d").alias("m"), "stage", value.alias("value"), label.alias("label"))
    bucket = reduce(lambda out, kv: F.when(c("stage") == kv[0], kv[1]).otherwise(out), BUCKETS.items(), F.lit(None))
    pl = monthly_results(v.filter((c("y") >= FIRST) & c("stage").isin(*BUCKETS)).withColumn("bucket", bucket))
    wc = labelled(v.select("company_id", "month", "label", F.when(c("inv_id") % 11 != 0, c("value")).alias("value"), c("inv_id").alias("at")), LABELS, 2)
    year = lambda y: F.sum(F.when(c("y") == y, c("value")))
    seg = v.filter(c("y").isin(LAST - 1, LAST) & (c("m") <= CLOSED)).groupBy("company_id", "stage").agg(year(LAST - 1).alias("ytd_before"), year(LAST).alias("ytd_now"))
    seg = seg.withColumn("yoy_ratio", F.try_divide(dbl("ytd_now"), F.nullif(dbl("ytd_before"), F.lit(0.0))) - 1)
    parts = [long(pl, "monthly_pl", c("month"), ["revenue", "cogs", "gross_profit", "gp_pct", "opex", "ebitda", "normalized_ebitda"]), long(wc, "working_capital", c("month"), list(LABELS.values())), long(seg, "segments", c("stage"), ["ytd_before", "ytd_now", "yoy_ratio"])]
    return reduce(DataFrame.unionByName, parts)
