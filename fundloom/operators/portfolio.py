"""Readings, scores and comparisons of portfolio companies (inventory G30 to G54, D13, C11, C13 and the like).

Readings are events: the number of an event decides which figure it reads, so that each company has several of some and none of others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import dbl, rounded
from .fundframe import ladder

#: All readings are before this date.
READ_AT = "2024-12-31"
#: What is read, in the order of the numbers.
SLUGS = ("revenue", "revenue-plan", "ebitda-margin", "cash-balance", "monthly-burn", "runway-months", "working-capital-ratio", "dscr", "top-customer-revenue-pct", "mrr", "ltv", "cac")
SECTORS = ("crypto mining", "retail", "saas", "pharma", "real estate", "steel")
RESOLUTIONS = ("CEO resignation", "routine matters", "budget passed", "director change")


def sql_list(x) -> str:
    return "[" + ", ".join(f"'{v}'" for v in x) + "]"


KPI = f"""kpi AS (SELECT holding_id AS company_id, val_id, ts, slug, CASE slug WHEN 'ebitda-margin' THEN v % 40 - 10 WHEN 'cash-balance' THEN v * 20 WHEN 'monthly-burn' THEN v - 20 WHEN 'runway-months' THEN v % 24 WHEN 'working-capital-ratio' THEN v / 50 WHEN 'dscr' THEN v / 60 WHEN 'top-customer-revenue-pct' THEN v % 70 WHEN 'cac' THEN v - 60 ELSE v END AS value
  FROM (SELECT *, {sql_list(SLUGS)}[val_id % {len(SLUGS)} + 1] AS slug, fair::DOUBLE AS v FROM val) WHERE val_id % 10 <> 9)"""


def kpi(t) -> DataFrame:
    """company_id, val_id, ts, slug and value of the approved readings."""
    v, slug = dbl("fair"), F.element_at(F.array(*map(F.lit, SLUGS)), (F.col("val_id") % len(SLUGS) + 1).cast("int"))
    rows = t.val.filter("val_id % 10 <> 9").select(F.col("holding_id").alias("company_id"), "val_id", "ts", slug.alias("slug"), v.alias("v"))
    v, is_ = F.col("v"), lambda s: F.col("slug") == s
    scaled = [(is_("ebitda-margin"), v % 40 - 10), (is_("cash-balance"), v * 20), (is_("monthly-burn"), v - 20), (is_("runway-months"), v % 24), (is_("working-capital-ratio"), v / 50), (is_("dscr"), v / 60), (is_("top-customer-revenue-pct"), v % 70), (is_("cac"), v - 60)]
    return rows.select("company_id", "val_id", "ts", "slug", ladder(scaled, v).alias("value"))


def graded(x: Column, steps: list[tuple[float, float]], low: float) -> Column:
    """The grade of the first step that x reaches, from the highest on; low below all."""
    return ladder([(x >= at, F.lit(float(grade))) for at, grade in steps], F.lit(float(low)))


def graded_sql(x: str, steps: list[tuple[float, float]], low: float) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {at} THEN {float(grade)}" for at, grade in steps) + f" ELSE {float(low)} END"


# Fixed values of the score: what a signal reads at which a grade from 0 (safe) to 10 is given, and how the signals are weighed.
PLAN, RUNWAY = [(0, 0), (-10, 2), (-20, 4), (-30, 6)], [(18, 0), (12, 2), (9, 4), (6, 6), (3, 8.5)]
CAPITAL, COVER, TOP = [(2, 0), (1.5, 2), (1, 4), (0.75, 7)], [(2, 0), (1.5, 2), (1.25, 4), (1, 6)], [(50, 9), (30, 6), (20, 3)]
WEIGHTS = {"plan": 0.15, "margin": 0.15, "burn": 0.15, "capital": 0.1, "debt": 0.1, "customer": 0.1, "management": 0.05, "market": 0.05, "peers": 0.1, "compliance": 0.05}
MARKET = (("crypto", 7), ("nft", 7), ("edtech", 7), ("gaming", 7), ("retail", 4), ("travel", 4), ("hospitality", 4), ("real estate", 4), ("healthcare", 1), ("pharma", 1), ("saas", 1), ("fintech", 1), ("deeptech", 1))
MANAGEMENT = "ceo|cfo|cto|resignation|appointment|director change"


@query("g52_ten_signals", f"""WITH {KPI}, n AS (SELECT *, row_number() OVER (PARTITION BY company_id, slug ORDER BY ts DESC, val_id DESC) AS rn FROM kpi),
  p AS (SELECT company_id, {', '.join(f"max(value) FILTER (slug = '{s}' AND rn = 1) AS k{i}" for i, s in enumerate(SLUGS))}, max(value) FILTER (slug = 'ebitda-margin' AND rn = 2) AS margin2, avg(value) FILTER (slug = 'monthly-burn' AND rn <= 3) AS burn FROM n WHERE rn <= 3 GROUP BY 1),
  m AS (SELECT holding_id AS company_id, count(*) FILTER (d >= DATE '{READ_AT}' - 365 AND regexp_matches(lower({sql_list(RESOLUTIONS)}[val_id % 4 + 1]), '{MANAGEMENT}')) AS changes FROM val WHERE methodology = 'signup' GROUP BY 1),
  e AS (SELECT holding_id AS company_id, arg_max(val_id % 2 = 1, (ts, val_id)) AS peers FROM val WHERE val_id % 3 = 0 GROUP BY 1), o AS (SELECT company_id, count(*) AS overdue FROM inv WHERE status = 'P' GROUP BY 1),
  s AS (SELECT c.company_id, CASE WHEN k0 IS NULL OR k1 IS NULL OR k1 <= 0 THEN 5.0 ELSE {graded_sql('(k0 - k1) / k1 * 100', PLAN, 9)} END AS plan,
    CASE WHEN margin2 IS NULL THEN 5.0 WHEN k2 < 0 THEN 8.0 WHEN k2 < 5 THEN 6.0 WHEN k2 < 10 THEN CASE WHEN k2 < margin2 THEN 5.0 ELSE 3.0 END ELSE greatest(0.0, 2.0 - (k2 - 10) * 0.1) END AS margin,
    CASE WHEN k3 IS NULL OR burn IS NULL THEN CASE WHEN k5 IS NULL THEN 5.0 ELSE {graded_sql('k5', RUNWAY, 10)} END WHEN burn <= 0 THEN 0.0 ELSE {graded_sql('k3 / burn', RUNWAY, 10)} END AS burn,
    CASE WHEN k6 IS NULL THEN 5.0 ELSE {graded_sql('k6', CAPITAL, 9.5)} END AS capital, CASE WHEN k7 IS NULL THEN 3.0 ELSE {graded_sql('k7', COVER, 9)} END AS debt, CASE WHEN k8 IS NULL THEN 5.0 ELSE {graded_sql('k8', TOP, 1)} END AS customer,
    CASE coalesce(changes, 0) WHEN 0 THEN 0.0 WHEN 1 THEN 2.0 WHEN 2 THEN 5.0 ELSE 8.0 END AS management,
    CASE {' '.join(f"WHEN contains({sql_list(SECTORS)}[c.company_id % 6 + 1], '{w}') THEN {g}.0" for w, g in MARKET)} ELSE 3.0 END AS market,
    CASE WHEN peers THEN 3.0 ELSE 5.0 END AS peers, CASE WHEN coalesce(overdue, 0) = 0 THEN 0.0 WHEN overdue <= 2 THEN 4.0 ELSE 8.0 END AS compliance
    FROM company c LEFT JOIN p USING (company_id) LEFT JOIN m USING (company_id) LEFT JOIN e USING (company_id) LEFT JOIN o USING (company_id)),
  w AS (SELECT *, round(least(greatest(({' + '.join(f'{k}::DOUBLE * {x}' for k, x in WEIGHTS.items())}) * 10, 0), 100), 1) AS score FROM s)
  SELECT company_id, {', '.join(f'{k}::DOUBLE AS {k}' for k in WEIGHTS)}, score, CASE WHEN score <= 33 THEN 'low' WHEN score <= 66 THEN 'medium' ELSE 'high' END AS tier FROM w""")
def g52(t):
    """Ten signals of a company, each with its own answer where nothing is known; weighed, times ten, clamped; tiers at 33 and 66."""
    newest = Window.partitionBy("company_id", "slug").orderBy(F.desc("ts"), F.desc("val_id"))
    n = kpi(t).withColumn("rn", F.row_number().over(newest)).filter("rn <= 3")
    read = lambda s, rn=1: F.max(F.when((F.col("slug") == s) & (F.col("rn") == rn), F.col("value")))
    p = n.groupBy("company_id").agg(*[read(s).alias(s) for s in SLUGS], read("ebitda-margin", 2).alias("margin2"), F.avg(F.when(F.col("slug") == "monthly-burn", F.col("value"))).alias("avg_burn"))
    told = F.lower(F.element_at(F.array(*map(F.lit, RESOLUTIONS)), (F.col("val_id") % 4 + 1).cast("int")))
    m = t.val.filter("methodology = 'signup'").groupBy(F.col("holding_id").alias("company_id")).agg(F.count_if((F.col("d") >= F.date_sub(F.lit(READ_AT).cast("date"), 365)) & told.rlike(MANAGEMENT)).alias("changes"))
    e = t.val.filter("val_id % 3 = 0").groupBy(F.col("holding_id").alias("company_id")).agg(F.max_by(F.col("val_id") % 2 == 1, F.struct("ts", "val_id")).alias("compared"))
    o = t.inv.filter("status = 'P'").groupBy("company_id").agg(F.count("*").alias("overdue"))
    s = t.company.select("company_id")
    for side in (p, m, e, o):
        s = s.join(side, "company_id", "left")
    c, lit = F.col, lambda x: F.lit(float(x))
    known = lambda x, grade, without: F.when(x.isNull(), lit(without)).otherwise(grade)
    runway = known(c("runway-months"), graded(c("runway-months"), RUNWAY, 10), 5)
    sector = F.element_at(F.array(*map(F.lit, SECTORS)), (c("company_id") % 6 + 1).cast("int"))
    changes, overdue = F.coalesce("changes", F.lit(0)), F.coalesce("overdue", F.lit(0))
    signals = {
        "plan": F.when(c("revenue").isNull() | c("revenue-plan").isNull() | (c("revenue-plan") <= 0), lit(5)).otherwise(graded((c("revenue") - c("revenue-plan")) / c("revenue-plan") * 100, PLAN, 9)),
        "margin": ladder([(c("margin2").isNull(), lit(5)), (c("ebitda-margin") < 0, lit(8)), (c("ebitda-margin") < 5, lit(6)), ((c("ebitda-margin") < 10) & (c("ebitda-margin") < c("margin2")), lit(5)), (c("ebitda-margin") < 10, lit(3))], F.greatest(lit(0), 2.0 - (c("ebitda-margin") - 10) * 0.1)),
        "burn": ladder([(c("cash-balance").isNull() | c("avg_burn").isNull(), runway), (c("avg_burn") <= 0, lit(0))], graded(F.try_divide("cash-balance", "avg_burn"), RUNWAY, 10)),
        "capital": known(c("working-capital-ratio"), graded(c("working-capital-ratio"), CAPITAL, 9.5), 5),
        "debt": known(c("dscr"), graded(c("dscr"), COVER, 9), 3),
        "customer": known(c("top-customer-revenue-pct"), graded(c("top-customer-revenue-pct"), TOP, 1), 5),
        "management": ladder([(changes == 0, lit(0)), (changes == 1, lit(2)), (changes == 2, lit(5))], lit(8)),
        "market": ladder([(sector.contains(w), lit(g)) for w, g in MARKET], lit(3)),
        "peers": F.when(c("compared"), lit(3)).otherwise(lit(5)),
        "compliance": ladder([(overdue == 0, lit(0)), (overdue <= 2, lit(4))], lit(8)),
    }
    s = s.select("company_id", *[x.alias(k) for k, x in signals.items()])
    score = rounded(F.least(F.greatest(sum((c(k) * w for k, w in list(WEIGHTS.items())[1:]), c("plan") * WEIGHTS["plan"]) * 10, lit(0)), lit(100)), 1)
    return s.withColumn("score", score).withColumn("tier", ladder([(c("score") <= 33, F.lit("low")), (c("score") <= 66, F.lit("medium"))], F.lit("high")))


#: Quarterly figures of a company, from its investments' costs by stage.
MIS = """mis AS (SELECT company_id, year(d) * 4 + quarter(d) AS q, sum(CASE WHEN stage IN ('1-URGENT', '2-HIGH') THEN cost ELSE 0 END)::DOUBLE AS revenue, sum(CASE WHEN stage = '3-MEDIUM' THEN cost ELSE 0 END)::DOUBLE AS costs, sum(CASE WHEN stage = '5-LOW' THEN cost END)::DOUBLE AS debt,
  sum(CASE WHEN status = 'O' THEN cost END)::DOUBLE AS assets, sum(CASE WHEN status = 'F' THEN cost END)::DOUBLE AS liabilities, sum(CASE WHEN stage LIKE '4%' THEN cost END)::DOUBLE AS cash FROM inv GROUP BY 1, 2)"""


def mis(t) -> DataFrame:
    of = lambda cond, name, zero=False: F.sum(F.when(cond, F.col("cost")).otherwise(0) if zero else F.when(cond, F.col("cost"))).cast("double").alias(name)
    stage, status = F.col("stage"), F.col("status")
    return t.inv.groupBy("company_id", (F.year("d") * 4 + F.quarter("d")).alias("q")).agg(
        of(stage.isin("1-URGENT", "2-HIGH"), "revenue", True), of(stage == "3-MEDIUM", "costs", True), of(stage == "5-LOW", "debt"), of(status == "O", "assets"), of(status == "F", "liabilities"), of(stage.startswith("4"), "cash")
    )


FEATURES = f"""{MIS}, r AS (SELECT *, revenue - costs AS ebitda, row_number() OVER (PARTITION BY company_id ORDER BY q DESC) AS rn FROM mis),
a AS (SELECT company_id, {', '.join(f'max({x}) FILTER (rn = 1) AS {x}, max({x}) FILTER (rn = 2) AS {x}2' for x in ('revenue', 'ebitda', 'cash', 'debt', 'assets', 'liabilities'))} FROM r WHERE rn <= 2 GROUP BY 1),
f AS (SELECT a.company_id, sector, assets / nullif(liabilities, 0) AS current_ratio, debt / nullif(assets, 0) AS debt_equity, ebitda / nullif(revenue, 0) * 100 AS ebitda_margin, {', '.join(f'({x} - {x}2) / abs(nullif({x}2, 0)) * 100 AS {x}_qoq' for x in ('revenue', 'ebitda', 'cash', 'debt'))} FROM a JOIN (SELECT company_id, sector FROM company) USING (company_id)),
z AS (SELECT p.company_id, {', '.join(f"CASE WHEN count(o.{x}) < 2 THEN NULL WHEN stddev_samp(o.{x}) = 0 THEN 0.0 ELSE (max(p.{x}) - avg(o.{x})) / stddev_samp(o.{x}) END AS {x}_z" for x in ('current_ratio', 'debt_equity', 'ebitda_margin'))} FROM f p LEFT JOIN f o ON p.sector = o.sector AND p.company_id <> o.company_id GROUP BY 1)"""
RATIOS, TRENDS = ("current_ratio", "debt_equity", "ebitda_margin"), ("revenue", "ebitda", "cash", "debt")


def features(t) -> DataFrame:
    """Ratios of a company's newest quarter and changes from the one before; null where a side is missing or zero."""
    newest = Window.partitionBy("company_id").orderBy(F.desc("q"))
    r = mis(t).withColumn("ebitda", F.col("revenue") - F.col("costs")).withColumn("rn", F.row_number().over(newest)).filter("rn <= 2")
    a = r.groupBy("company_id").agg(*[F.max(F.when(F.col("rn") == i, F.col(x))).alias(x + s) for x in (*TRENDS, "assets", "liabilities") for i, s in ((1, ""), (2, "2"))])
    over = lambda x, y: F.try_divide(F.col(x), F.nullif(F.col(y), F.lit(0.0)))
    change = lambda x: F.try_divide(F.col(x) - F.col(f"{x}2"), F.abs(F.nullif(F.col(f"{x}2"), F.lit(0.0)))) * 100
    return a.join(t.company.select("company_id", "sector"), "company_id").select("company_id", "sector", over("assets", "liabilities").alias("current_ratio"), over("debt", "assets").alias("debt_equity"), (over("ebitda", "revenue") * 100).alias("ebitda_margin"), *[change(x).alias(f"{x}_qoq") for x in TRENDS])


def peer_scores(f: DataFrame, columns=RATIOS) -> DataFrame:
    """f with each column's distance from the mean of the sector's other companies, in their sample deviations.

    The others' moments are the sector's sums less the company's own, about the sector's mean, so no pair of companies is made. Fewer than two others: null; no deviation: 0.
    """
    means = f.groupBy("sector").agg(*[F.avg(x).alias(f"{x}_m") for x in columns])
    g = f.join(means, "sector")
    off = {x: F.col(x) - F.col(f"{x}_m") for x in columns}
    sums = g.groupBy("sector").agg(*[s for x in columns for s in (F.count(x).alias(f"{x}_n"), F.sum(off[x]).alias(f"{x}_s"), F.sum(off[x] * off[x]).alias(f"{x}_q"))])
    g = g.join(sums, "sector")
    for x in columns:
        own, has = F.coalesce(off[x], F.lit(0.0)), F.when(F.col(x).isNotNull(), 1).otherwise(0)
        n, s, q = F.col(f"{x}_n") - has, F.col(f"{x}_s") - own, F.col(f"{x}_q") - own * own
        left = q - s * s / F.nullif(n, F.lit(0))
        same = left <= 1e-12 * F.col(f"{x}_q")  # what rounding leaves of the sector's squares
        deviation = F.sqrt(F.greatest(left, F.lit(0.0)) / F.nullif(n - 1, F.lit(0)))
        g = g.withColumn(f"{x}_z", F.when(n < 2, None).when(same, 0.0).otherwise(F.try_divide(off[x] - s / F.nullif(n, F.lit(0)), deviation)))
    return g


@query("d13_peer_deviation", f"WITH {FEATURES} SELECT company_id, round(current_ratio_z, 4) AS current_ratio_z, round(debt_equity_z, 4) AS debt_equity_z, round(ebitda_margin_z, 4) AS ebitda_margin_z FROM z")
def d13(t):
    return peer_scores(features(t)).select("company_id", *[F.round(f"{x}_z", 4).alias(f"{x}_z") for x in RATIOS])


ALL = f"""{FEATURES}, bv AS (SELECT company_id, min(pct) AS worst_variance, count(*) FILTER (pct < -10) AS adverse FROM (SELECT company_id, round((sum(cost) FILTER (year(d) = 2000) - sum(cost) FILTER (year(d) = 1999))::DOUBLE / abs(nullif(sum(cost) FILTER (year(d) = 1999), 0))::DOUBLE * 100, 4) AS pct FROM inv WHERE year(d) IN (1999, 2000) GROUP BY company_id, stage) GROUP BY 1),
w AS (SELECT f.*, z.* EXCLUDE (company_id), a.cash / nullif(-a.ebitda / 3, 0) AS runway, worst_variance, coalesce(adverse, 0) AS adverse FROM f JOIN z USING (company_id) JOIN a USING (company_id) LEFT JOIN bv USING (company_id))"""


def all_features(t) -> DataFrame:
    """features() with peer scores, the months that cash lasts at the last quarter's monthly burn, and the worst and the number of adverse variances from the year before."""
    newest = mis(t).withColumn("rn", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("q")))).filter("rn = 1")
    burn = -(F.col("revenue") - F.col("costs")) / 3
    left = newest.select("company_id", F.try_divide("cash", F.nullif(burn, F.lit(0.0))).alias("runway"))
    year = lambda y: F.sum(F.when(F.year("d") == y, F.col("cost")))
    v = t.inv.filter("year(d) in (1999, 2000)").groupBy("company_id", "stage").agg(year(2000).alias("actual"), year(1999).alias("budget"))
    pct = F.round(F.try_divide(dbl(F.col("actual") - F.col("budget")), dbl(F.abs(F.nullif("budget", F.lit(0).cast("decimal(18,2)"))))) * 100, 4)
    v = v.select("company_id", pct.alias("pct")).groupBy("company_id").agg(F.min("pct").alias("worst_variance"), F.count_if(F.col("pct") < -10).alias("adverse"))
    out = peer_scores(features(t)).join(left, "company_id").join(v, "company_id", "left")
    return out.withColumn("adverse", F.coalesce("adverse", F.lit(0)))


@query("g53_company_features", f"WITH {ALL} SELECT company_id, {', '.join(f'round({x}, 4) AS {x}' for x in ('current_ratio', 'debt_equity', 'ebitda_margin', 'revenue_qoq', 'ebitda_qoq', 'cash_qoq', 'debt_qoq', 'current_ratio_z', 'debt_equity_z', 'ebitda_margin_z', 'runway', 'worst_variance'))}, adverse FROM w")
def g53(t):
    return all_features(t).select("company_id", *[F.round(x, 4).alias(x) for x in (*RATIOS, *[f"{x}_qoq" for x in TRENDS], *[f"{r}_z" for r in RATIOS], "runway", "worst_variance")], "adverse")


# Fixed values of the alternative score: thresholds (reached if strictly over, or strictly under), grades, the grade beyond all, and the grade where nothing is known.
ALTERNATIVE = {
    "plan": ("worst_variance", ">", ((-10, 2), (-25, 5), (-50, 7)), 10, 5), "burn": ("runway", ">", ((18, 1), (12, 3), (6, 6)), 9, 5), "capital": ("current_ratio", ">", ((2.0, 1), (1.5, 3), (1.0, 6)), 9, 5), "debt": ("debt_equity", "<", ((0.5, 1), (1.0, 3), (2.0, 5), (3.0, 7)), 9, 4),
}
ALTERNATIVE_WEIGHTS = {"plan": 0.15, "margin": 0.15, "burn": 0.15, "capital": 0.1, "debt": 0.1, "customer": 0.1, "management": 0.05, "market": 0.1, "peers": 0.05, "compliance": 0.05}
SIGNALS = ", ".join(f"CASE WHEN {x} IS NULL THEN {none}.0 {' '.join(f'WHEN {x} {op} {at} THEN {grade}.0' for at, grade in steps)} ELSE {last}.0 END AS {name}" for name, (x, op, steps, last, none) in ALTERNATIVE.items())


@query("g54_alternative_score", f"""WITH {ALL}, s AS (SELECT company_id, {SIGNALS}, CASE WHEN ebitda_margin IS NULL THEN 5.0 WHEN ebitda_margin > 20 AND coalesce(ebitda_qoq, 0) > 0 THEN 1.0 WHEN ebitda_margin > 10 THEN 4.0 WHEN ebitda_margin > 0 THEN 6.0 ELSE 9.0 END AS margin,
  CASE WHEN ebitda_margin_z IS NULL THEN 5.0 ELSE greatest(0, least(10, 5.0 + ebitda_margin_z)) END AS peers, 5.0 AS customer, 5.0 AS management, 5.0 AS market, 5.0 AS compliance FROM w),
  sc AS (SELECT *, round(({' + '.join(f'{k}::DOUBLE * {x}::DOUBLE' for k, x in ALTERNATIVE_WEIGHTS.items())}) * 10, 3) AS score FROM s)
  SELECT company_id, {', '.join(f'round({k}::DOUBLE, 4) AS {k}' for k in ALTERNATIVE_WEIGHTS)}, score, CASE WHEN score <= 33 THEN 'low' WHEN score <= 66 THEN 'medium' ELSE 'high' END AS tier FROM sc""")
def g54(t):
    """Ten signals from a company's figures alone, weighed otherwise than the main score; four are neutral, as they need other sources. At a threshold the worse grade holds."""
    c, lit = F.col, lambda x: F.lit(float(x))
    reached = lambda x, op, at: c(x) > at if op == ">" else c(x) < at
    signals = {name: ladder([(c(x).isNull(), lit(none)), *[(reached(x, op, at), lit(grade)) for at, grade in steps]], lit(last)) for name, (x, op, steps, last, none) in ALTERNATIVE.items()}
    signals["margin"] = ladder([(c("ebitda_margin").isNull(), lit(5)), ((c("ebitda_margin") > 20) & (F.coalesce("ebitda_qoq", lit(0)) > 0), lit(1)), (c("ebitda_margin") > 10, lit(4)), (c("ebitda_margin") > 0, lit(6))], lit(9))
    signals["peers"] = F.when(c("ebitda_margin_z").isNull(), lit(5)).otherwise(F.greatest(lit(0), F.least(lit(10), c("ebitda_margin_z") + 5.0)))
    s = all_features(t).select("company_id", *[signals.get(k, lit(5)).alias(k) for k in ALTERNATIVE_WEIGHTS])
    weighed = [c(k) * w for k, w in ALTERNATIVE_WEIGHTS.items()]
    score = F.round(sum(weighed[1:], weighed[0]) * 10, 3)
    s = s.withColumn("score", score).withColumn("tier", ladder([(c("score") <= 33, F.lit("low")), (c("score") <= 66, F.lit("medium"))], F.lit("high")))
    return s.select("company_id", *[F.round(k, 4).alias(k) for k in ALTERNATIVE_WEIGHTS], "score", "tier")


#: Monthly figures of a sector, and its budget: what it had in the same months of the year before.
PL = """pl AS (SELECT sector AS node, strftime(d, '%Y-%m') AS period, sum(CASE WHEN stage IN ('1-URGENT', '2-HIGH') THEN cost ELSE 0 END)::DOUBLE AS revenue, sum(CASE WHEN stage = '3-MEDIUM' THEN cost ELSE 0 END)::DOUBLE AS cogs, sum(CASE WHEN stage = '5-LOW' THEN cost ELSE 0 END)::DOUBLE AS opex FROM inv JOIN company USING (company_id) GROUP BY 1, 2),
last AS (SELECT node, max(period) AS period FROM pl GROUP BY 1),
yr AS (SELECT pl.node, last.period, max(revenue) FILTER (pl.period = last.period) AS revenue, max(revenue - cogs) FILTER (pl.period = last.period) AS gp, max(revenue - cogs - opex) FILTER (pl.period = last.period) AS ebitda,
  sum(revenue) FILTER (left(pl.period, 4) = left(last.period, 4)) AS ytd_revenue, sum(revenue - cogs) FILTER (left(pl.period, 4) = left(last.period, 4)) AS ytd_gp, sum(revenue - cogs - opex) FILTER (left(pl.period, 4) = left(last.period, 4)) AS ytd_ebitda,
  sum(revenue) FILTER (left(pl.period, 4)::INT = left(last.period, 4)::INT - 1 AND right(pl.period, 2) <= right(last.period, 2)) AS prior_revenue, sum(revenue - cogs - opex) FILTER (left(pl.period, 4)::INT = left(last.period, 4)::INT - 1 AND right(pl.period, 2) <= right(last.period, 2)) AS prior_ebitda FROM pl JOIN last USING (node) GROUP BY 1, 2)"""


def monthly(t) -> DataFrame:
    """node, period, revenue, cogs, opex: costs are summed to company and month before sectors are known."""
    of = lambda *s: F.sum(F.when(F.col("stage").isin(*s), F.col("cost")).otherwise(0))
    per = t.inv.groupBy("company_id", F.date_format("d", "yyyy-MM").alias("period")).agg(of("1-URGENT", "2-HIGH").alias("revenue"), of("3-MEDIUM").alias("cogs"), of("5-LOW").alias("opex"))
    return per.join(t.company.select("company_id", F.col("sector").alias("node")), "company_id").groupBy("node", "period").agg(*[F.sum(c).cast("double").alias(c) for c in ("revenue", "cogs", "opex")])


def yearly(t) -> DataFrame:
    """node, the last month and its figures, those of its year so far, and of the same months of the year before."""
    pl = monthly(t).withColumn("gp", F.col("revenue") - F.col("cogs")).withColumn("ebitda", F.col("gp") - F.col("opex"))
    pl = pl.join(pl.groupBy("node").agg(F.max("period").alias("last")), "node")
    y, m = lambda c: F.substring(c, 1, 4).cast("int"), lambda c: F.substring(c, 6, 2)
    now, this, prior = F.col("period") == F.col("last"), y("period") == y("last"), (y("period") == y("last") - 1) & (m("period") <= m("last"))
    of = lambda cond, c, name: F.sum(F.when(cond, F.col(c))).alias(name)
    return pl.groupBy("node", F.col("last").alias("period")).agg(*[of(now, c, c) for c in ("revenue", "gp", "ebitda")], *[of(this, c, f"ytd_{c}") for c in ("revenue", "gp", "ebitda")], *[of(prior, c, f"prior_{c}") for c in ("revenue", "ebitda")])


def pct_of(x: Column, base: Column) -> Column:
    return F.round(F.try_divide(x, F.nullif(base, F.lit(0.0))) * 100, 2)


@query("g49_compare_actual", f"WITH {PL} SELECT node, round(revenue, 2) AS actual, round(prior_revenue, 2) AS budget, round(round(revenue, 2) - round(prior_revenue, 2), 2) AS variance, round((round(revenue, 2) - round(prior_revenue, 2)) / nullif(round(prior_revenue, 2), 0) * 100, 2) AS variance_pct FROM yr")
def g49_actual(t):
    """Newest month's revenue beside the budget of the year so far, as the screen puts them."""
    a, b = F.round("revenue", 2), F.round("prior_revenue", 2)
    return yearly(t).select("node", a.alias("actual"), b.alias("budget"), F.round(a - b, 2).alias("variance"), pct_of(a - b, b).alias("variance_pct"))


@query("g49_compare_sales_margin", f"WITH {PL}, x AS (SELECT node, coalesce(nullif(revenue, 0), ytd_revenue) AS r, coalesce(nullif(gp, 0), ytd_gp) AS g, CASE WHEN revenue <> 0 THEN round(gp / revenue * 100, 2) END AS p, coalesce(nullif(ebitda, 0), ytd_ebitda) AS e FROM yr) SELECT node, round(r, 2) AS revenue, round(g, 2) AS gross_profit, CASE WHEN p IS NOT NULL THEN p WHEN r <> 0 AND g <> 0 THEN round(g / r * 100, 2) END AS gp_pct, round(e, 2) AS ebitda FROM x")
def g49_margin(t):
    """A month's zero counts as missing; the year so far stands in."""
    c, zero = F.col, F.lit(0.0)
    first = lambda x: F.coalesce(F.nullif(c(x), zero), c(f"ytd_{x}"))
    x = yearly(t).select("node", first("revenue").alias("r"), first("gp").alias("g"), F.when(c("revenue") != 0, pct_of(c("gp"), c("revenue"))).alias("p"), first("ebitda").alias("e"))
    return x.select("node", F.round("r", 2).alias("revenue"), F.round("g", 2).alias("gross_profit"), F.coalesce("p", F.when((c("r") != 0) & (c("g") != 0), pct_of(c("g"), c("r")))).alias("gp_pct"), F.round("e", 2).alias("ebitda"))


@query("g49_compare_variance", f"WITH {PL}, x AS (SELECT node, 'revenue' AS metric, ytd_revenue AS a, prior_revenue AS b FROM yr UNION ALL SELECT node, 'ebitda', ytd_ebitda, prior_ebitda FROM yr) SELECT node, metric, round(a, 2) AS actual, round(b, 2) AS budget, round(a - b, 2) AS variance, round((a - b) / nullif(b, 0) * 100, 2) AS variance_pct FROM x")
def g49_variance(t):
    """Of revenue and EBITDA, the only ones with a budget."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"ytd_{m}").alias("a"), F.col(f"prior_{m}").alias("b")) for m in ("revenue", "ebitda")]))
    x = yearly(t).select("node", each.alias("x")).select("node", "x.*")
    return x.select("node", "metric", F.round("a", 2).alias("actual"), F.round("b", 2).alias("budget"), F.round(F.col("a") - F.col("b"), 2).alias("variance"), pct_of(F.col("a") - F.col("b"), F.col("b")).alias("variance_pct"))


YOY = "round((ytd_revenue - prior_revenue) / nullif(prior_revenue, 0) * 100, 2)"


@query("g49_compare_kpi_range", f"WITH {PL}, s AS (SELECT node, sum(revenue) AS r, sum(revenue - cogs) AS g, sum(revenue - cogs - opex) AS e, count(*) AS n FROM pl WHERE period BETWEEN '1998-03' AND '1998-09' GROUP BY 1) SELECT node, round(r, 2) AS revenue, round(g, 2) AS gross_profit, round(g / nullif(r, 0) * 100, 2) AS gp_pct, round(e, 2) AS ebitda, round(e / nullif(r, 0) * 100, 2) AS ebitda_pct, {YOY} AS yoy_pct, coalesce(n || ' months', 'no data in range') AS note FROM yr LEFT JOIN s USING (node)")
def g49_range(t):
    """Months of a range, sums first and ratios of the sums; a node without any keeps its row."""
    c = F.col
    s = monthly(t).filter(c("period").between("1998-03", "1998-09")).groupBy("node").agg(F.sum("revenue").alias("r"), F.sum(c("revenue") - c("cogs")).alias("g"), F.sum(c("revenue") - c("cogs") - c("opex")).alias("e"), F.count("*").alias("n"))
    j = yearly(t).select("node", "ytd_revenue", "prior_revenue").join(s, "node", "left")
    note = F.coalesce(F.concat(c("n").cast("string"), F.lit(" months")), F.lit("no data in range"))
    return j.select("node", F.round("r", 2).alias("revenue"), F.round("g", 2).alias("gross_profit"), pct_of(c("g"), c("r")).alias("gp_pct"), F.round("e", 2).alias("ebitda"), pct_of(c("e"), c("r")).alias("ebitda_pct"), pct_of(c("ytd_revenue") - c("prior_revenue"), c("prior_revenue")).alias("yoy_pct"), note.alias("note"))


@query("g49_compare_kpi_as_of", f"WITH {PL}, s AS (SELECT * FROM pl WHERE period = '1999-05') SELECT node, round(coalesce(s.revenue, yr.revenue), 2) AS revenue, round(CASE WHEN s.node IS NOT NULL THEN s.revenue - s.cogs ELSE coalesce(nullif(ytd_gp, 0), gp) END, 2) AS gross_profit, {YOY} AS yoy_pct, CASE WHEN s.node IS NOT NULL THEN 'as of 1999-05' ELSE 'summary snapshot' END AS note FROM yr LEFT JOIN s USING (node)")
def g49_as_of(t):
    """The month asked for, else the summary of the newest month and its year."""
    c = F.col
    s = monthly(t).filter("period = '1999-05'").select("node", c("revenue").alias("r"), (c("revenue") - c("cogs")).alias("g"))
    j = yearly(t).join(s, "node", "left")
    return j.select("node", F.round(F.coalesce("r", "revenue"), 2).alias("revenue"), F.round(F.coalesce("g", F.nullif(c("ytd_gp"), F.lit(0.0)), "gp"), 2).alias("gross_profit"), pct_of(c("ytd_revenue") - c("prior_revenue"), c("prior_revenue")).alias("yoy_pct"), F.when(c("r").isNotNull(), "as of 1999-05").otherwise("summary snapshot").alias("note"))


@query("p02_year_list", f"WITH {PL} SELECT * FROM pl WHERE left(period, 4) IN ('1997', '1999')")
def p02(t):
    return monthly(t).filter(F.substring("period", 1, 4).isin("1997", "1999"))


@query("n20_company_pl_pack", f"WITH {MIS}, l AS (SELECT company_id, arg_max(revenue, q) AS revenue, arg_max(revenue - costs, q) AS ebitda, max(q) AS q FROM mis GROUP BY 1), {KPI}, k AS (SELECT company_id, arg_max(value, (ts, val_id)) / 40 AS v FROM kpi WHERE slug = 'ebitda-margin' GROUP BY 1) SELECT l.company_id, q, round(revenue, 2) AS revenue, round(ebitda, 2) AS ebitda, round(CASE WHEN revenue <> 0 THEN ebitda / revenue * 100 WHEN abs(v) < 1 THEN v * 100 ELSE v END, 4) AS ebitda_pct FROM l LEFT JOIN k USING (company_id)")
def n20(t):
    """Newest quarter of each company; without revenue its margin is the newest reading, a fraction if under one."""
    l = mis(t).groupBy("company_id").agg(F.max_by(F.struct("revenue", (F.col("revenue") - F.col("costs")).alias("ebitda"), "q"), "q").alias("l")).select("company_id", "l.*")
    k = kpi(t).filter("slug = 'ebitda-margin'").groupBy("company_id").agg((F.max_by("value", F.struct("ts", "val_id")) / 40).alias("v"))
    margin = ladder([(F.col("revenue") != 0, F.try_divide("ebitda", "revenue") * 100), (F.abs("v") < 1, F.col("v") * 100)], F.col("v"))
    return l.join(k, "company_id", "left").select("company_id", "q", F.round("revenue", 2).alias("revenue"), F.round("ebitda", 2).alias("ebitda"), F.round(margin, 4).alias("ebitda_pct"))


@query("g44_saas_metrics", f"WITH {KPI}, l AS (SELECT company_id, max(v) FILTER (slug = 'mrr') AS mrr, max(v) FILTER (slug = 'ltv') AS ltv, max(v) FILTER (slug = 'cac') AS cac FROM (SELECT company_id, CASE slug WHEN 'monthly-burn' THEN 'mrr' ELSE slug END AS slug, arg_max(value, (ts, val_id)) AS v FROM kpi WHERE slug IN ('mrr', 'monthly-burn', 'ltv', 'cac') GROUP BY 1, 2) GROUP BY 1) SELECT c.company_id, mrr, ltv, cac, CASE WHEN ltv <> 0 AND cac <> 0 THEN round(ltv / cac, 4) END AS ltv_cac_ratio FROM company c LEFT JOIN l USING (company_id)")
def g44(t):
    """Variants of a figure's name become one; the newest reading of each, for all companies; the ratio where both sides are there and aren't 0."""
    slug = F.when(F.col("slug") == "monthly-burn", "mrr").otherwise(F.col("slug"))
    rows = kpi(t).filter(F.col("slug").isin("mrr", "monthly-burn", "ltv", "cac")).withColumn("slug", slug)
    newest = lambda s: F.max_by(F.when(F.col("slug") == s, F.col("value")), F.when(F.col("slug") == s, F.struct("ts", "val_id"))).alias(s)
    l = rows.groupBy("company_id").agg(*map(newest, ("mrr", "ltv", "cac")))
    both = (F.col("ltv") != 0) & (F.col("cac") != 0)
    return t.company.select("company_id").join(l, "company_id", "left").withColumn("ltv_cac_ratio", F.when(both, F.round(F.try_divide("ltv", "cac"), 4)))


#: Columns of the matrix and the names that belong to each, the more special first.
COLUMNS = (("revenue", ("net_revenue", "revenue")), ("gross_m", ("gross_margin", "gross_m")), ("ebitda", ("ebitda_margin", "ebitda")), ("orders", ("orders",)), ("aov", ("average_order_value", "aov")), ("cac", ("blended_cac", "cac")))
GIVEN = ("revenue", "net-revenue-rs-cr", "gross-m", "EBITDA Margin INR", "order", "aov", "blended cac (inr)", "churn")
TOKENS = ", ".join(f"({i}, '{c}', {j}, '{s}')" for i, (c, names) in enumerate(COLUMNS) for j, s in enumerate(names))


def column_of(slug: Column, columns=COLUMNS) -> Column:
    """The matrix column of a normalised name: one that equals it, else the first with a name that contains it or is contained in it."""
    exact = [(slug == s, F.lit(c)) for c, names in columns for s in names]
    either = [(slug.contains(s) | F.contains(F.lit(s), slug), F.lit(c)) for c, names in columns for s in names]
    return ladder([*exact, *either], F.lit(None).cast("string"))


def canonical(slug: Column) -> Column:
    return F.regexp_replace(F.lower(slug), "[^a-z0-9]+", "_")


MATRIX = f"""tok(i, col, j, name) AS (VALUES {TOKENS}), named AS (SELECT holding_id AS company_id, val_id, ts, fair::DOUBLE / 100 AS value, regexp_replace(lower({sql_list(GIVEN)}[val_id % {len(GIVEN)} + 1]), '[^a-z0-9]+', '_', 'g') AS slug FROM val),
  hit AS (SELECT slug, coalesce((SELECT arg_min(col, i * 10 + j) FROM tok WHERE name = slug), (SELECT arg_min(col, i * 10 + j) FROM tok WHERE contains(slug, name) OR contains(name, slug))) AS col FROM (SELECT DISTINCT slug FROM named))"""


@query("c13_slug_to_column", f"WITH {MATRIX} SELECT slug, col FROM hit")
def c13(t):
    given = t.val.select(canonical(F.element_at(F.array(*map(F.lit, GIVEN)), (F.col("val_id") % len(GIVEN) + 1).cast("int"))).alias("slug")).distinct()
    return given.select("slug", column_of(F.col("slug")).alias("col"))


@query("p15_report_kpi_matrix", f"WITH {MATRIX}, l AS (SELECT company_id, col, arg_max(value, (ts, val_id)) AS v FROM named JOIN hit USING (slug) WHERE col IS NOT NULL GROUP BY 1, 2) SELECT company_id, {', '.join(f"max(CASE WHEN col IN ('gross_m', 'ebitda') AND abs(v) < 1 THEN round(v * 100, 2) ELSE v END) FILTER (col = '{c}') AS {c}" for c, _ in COLUMNS)} FROM l GROUP BY 1")
def p15(t):
    """Newest reading of each column of a company; fractions of percent columns become percent."""
    slug = canonical(F.element_at(F.array(*map(F.lit, GIVEN)), (F.col("val_id") % len(GIVEN) + 1).cast("int")))
    named = t.val.select(F.col("holding_id").alias("company_id"), "val_id", "ts", (dbl("fair") / 100).alias("value"), column_of(slug).alias("col")).filter("col is not null")
    l = named.groupBy("company_id", "col").agg(F.max_by("value", F.struct("ts", "val_id")).alias("v"))
    v = F.when(F.col("col").isin("gross_m", "ebitda") & (F.abs("v") < 1), F.round(F.col("v") * 100, 2)).otherwise(F.col("v"))
    return l.groupBy("company_id").agg(*[F.max(F.when(F.col("col") == c, v)).alias(c) for c, _ in COLUMNS])


#: Rows of a valuation sheet, told apart by val_id: some say a cost, some an instrument, some a round, some nothing.
MATCH = """cand AS (SELECT inv_id, company_id, d, cost, status AS instrument, stage FROM inv),
rows_ AS (SELECT v.val_id, v.holding_id AS company_id, v.d, CASE WHEN v.val_id % 4 = 0 THEN f.cost + (v.val_id % 3) * 0.3::DECIMAL(2,1) END AS cost, CASE WHEN v.val_id % 4 = 1 THEN ['F', 'O', 'P', 'X'][v.val_id // 4 % 4 + 1] END AS instrument, CASE WHEN v.val_id % 4 = 2 THEN lower(['1-URGENT', '5-LOW', '9-NONE'][v.val_id // 4 % 3 + 1]) END AS stage
  FROM val v JOIN (SELECT company_id, arg_max(cost, (d, inv_id)) AS cost FROM inv GROUP BY 1) f ON f.company_id = v.holding_id),
scored AS (SELECT val_id, r.company_id, r.d, inv_id, c.d AS inv_d, CASE WHEN abs(c.cost - r.cost) < 0.5 THEN 1 WHEN c.instrument = r.instrument THEN 2 WHEN lower(c.stage) = r.stage THEN 3 END AS rung FROM rows_ r JOIN cand c USING (company_id)),
best AS (SELECT val_id, company_id, d, arg_min(inv_id, (rung, inv_d, inv_id)) FILTER (rung IS NOT NULL) AS inv_id, min(rung) AS rung FROM scored GROUP BY 1, 2, 3),
taken AS (SELECT DISTINCT company_id, d, inv_id FROM best WHERE inv_id IS NOT NULL),
free AS (SELECT company_id, d, inv_id, row_number() OVER (PARTITION BY company_id, d ORDER BY inv_d, inv_id) AS nth FROM (SELECT DISTINCT b.company_id, b.d, c.inv_id, c.d AS inv_d FROM best b JOIN cand c USING (company_id) WHERE b.inv_id IS NULL) ANTI JOIN taken USING (company_id, d, inv_id)),
rest AS (SELECT val_id, company_id, d, row_number() OVER (PARTITION BY company_id, d ORDER BY val_id) AS nth FROM best WHERE inv_id IS NULL),
first AS (SELECT company_id, arg_min(inv_id, (d, inv_id)) AS inv_id FROM cand GROUP BY 1)"""


@query("c11_valuation_to_investment", f"WITH {MATCH} SELECT val_id, inv_id, rung FROM best WHERE inv_id IS NOT NULL UNION ALL SELECT val_id, coalesce(f.inv_id, e.inv_id), CASE WHEN f.inv_id IS NOT NULL THEN 4 ELSE 5 END FROM rest LEFT JOIN free f USING (company_id, d, nth) JOIN first e USING (company_id)")
def c11(t):
    """Which investment a valuation row is of: by cost, instrument or round; else rows of a company and day take, in order, its
    investments that no other row of the day has; else the earliest. A company's rows meet its own investments only."""
    c = F.col
    cand = t.inv.select("inv_id", "company_id", c("d").alias("inv_d"), c("cost").alias("inv_cost"), c("status").alias("inv_instrument"), c("stage").alias("inv_stage"))
    last = t.inv.groupBy("company_id").agg(F.max_by("cost", F.struct("d", "inv_id")).alias("last_cost"), F.min_by("inv_id", F.struct("d", "inv_id")).alias("first_inv"))
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.floor(c("val_id") / 4) % len(xs) + 1).cast("int"))
    kind = lambda k, x: F.when(c("val_id") % 4 == k, x)
    extra = (c("val_id") % 3) * F.lit(0.3).cast("decimal(2,1)")
    rows = t.val.select("val_id", c("holding_id").alias("company_id"), "d").join(last, "company_id")
    rows = rows.select("val_id", "company_id", "d", "first_inv", kind(0, c("last_cost") + extra).alias("cost"), kind(1, pick(("F", "O", "P", "X"))).alias("instrument"), kind(2, pick(("1-urgent", "5-low", "9-none"))).alias("stage"))
    rung = F.when(F.abs(c("inv_cost") - c("cost")) < 0.5, 1).when(c("inv_instrument") == c("instrument"), 2).when(F.lower("inv_stage") == c("stage"), 3)
    scored = rows.join(cand, "company_id").withColumn("rung", rung)
    best = scored.groupBy("val_id", "company_id", "d", "first_inv").agg(F.min_by("inv_id", F.when(c("rung").isNotNull(), F.struct("rung", "inv_d", "inv_id"))).alias("inv_id"), F.min("rung").alias("rung"))
    open_ = best.filter("inv_id is null").drop("inv_id", "rung")
    taken = best.filter("inv_id is not null").select("company_id", "d", "inv_id").distinct()
    nth = lambda *order: F.row_number().over(Window.partitionBy("company_id", "d").orderBy(*order))
    free = open_.select("company_id", "d").distinct().join(cand.select("company_id", "inv_id", "inv_d"), "company_id").join(taken, ["company_id", "d", "inv_id"], "left_anti").withColumn("nth", nth("inv_d", "inv_id"))
    rest = open_.withColumn("nth", nth("val_id")).join(free.select("company_id", "d", "nth", "inv_id"), ["company_id", "d", "nth"], "left")
    rest = rest.select("val_id", F.coalesce("inv_id", "first_inv").alias("inv_id"), F.when(c("inv_id").isNotNull(), 4).otherwise(5).alias("rung"))
    return best.filter("inv_id is not null").select("val_id", "inv_id", "rung").unionByName(rest)
