"""Queries over irregular sheets, and lists and checks with all their parts (inventory A03, B01, F12, H, I, J01, J10, K13, N and P)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..sources.tables import AS_OF, dbl, ratio
from .finance import COMPANY_RATES, company_rates
from .fundframe import ladder
from .portfolio import KPI, kpi
from .records import CELLS, cells
from .relational import LATEST_VAL, latest_valuation

#: A ragged grid over each company's orders: cells are missing, headers are shifted by the sheet's number, and some rows tie.
GRID = f"""{CELLS}, g AS (SELECT sheet, r + sheet % 3 AS row, 0 AS col, stage AS raw FROM cells WHERE inv_id % 7 <> 0 UNION ALL SELECT sheet, r + sheet % 3, 1, status FROM cells WHERE inv_id % 5 <> 0 UNION ALL SELECT sheet, r + sheet % 3, 2, CASE WHEN r % 4 = 2 THEN 'Total' ELSE cost::VARCHAR END FROM cells WHERE inv_id % 3 <> 0)"""


def grid(t) -> DataFrame:
    c = F.col
    at = c("r") + c("sheet") % 3
    three = [F.when(c("inv_id") % 7 != 0, F.struct(at.alias("row"), F.lit(0).alias("col"), c("stage").alias("raw"))), F.when(c("inv_id") % 5 != 0, F.struct(at.alias("row"), F.lit(1).alias("col"), c("status").alias("raw")))]
    three.append(F.when(c("inv_id") % 3 != 0, F.struct(at.alias("row"), F.lit(2).alias("col"), F.when(c("r") % 4 == 2, "Total").otherwise(c("cost").cast("string")).alias("raw"))))
    return cells(t).select("sheet", F.explode(F.array_compact(F.array(*three))).alias("x")).select("sheet", "x.*")


@query("a03_ragged_cell_lookup", f"WITH {GRID} SELECT DISTINCT g.sheet, q.raw FROM g LEFT JOIN (SELECT sheet, raw FROM g WHERE row = 3 AND col = 2) q USING (sheet)")
def a03(t):
    """Cell C3 of each sheet that has any cell; null where it is missing."""
    return grid(t).groupBy("sheet").agg(F.max(F.when((F.col("row") == 3) & (F.col("col") == 2), F.col("raw"))).alias("raw"))


@query("i01_ragged_header_row", f"WITH {GRID}, n AS (SELECT sheet, row, count(*) FILTER (try_cast(raw AS DOUBLE) IS NULL) AS n FROM g WHERE row <= 20 GROUP BY 1, 2), m AS (SELECT sheet, max(n) AS n FROM n WHERE n >= 3 GROUP BY 1) SELECT sheet, min(row) AS header FROM n JOIN m USING (sheet, n) GROUP BY 1")
def i01(t):
    """Of the first 20 rows the first of those with most text cells, three at least; sheets without such a row have no header."""
    c = F.col
    n = grid(t).filter("row <= 20").groupBy("sheet", "row").agg(F.count_if(c("raw").try_cast("double").isNull()).alias("n")).filter("n >= 3")
    return n.groupBy("sheet").agg(F.max_by("row", F.struct("n", -c("row"))).alias("header"))


@query("i02_column_scores", f"WITH {GRID}, s AS (SELECT sheet, col, count(*) FILTER (try_cast(raw AS DOUBLE) IS NOT NULL) AS numbers, count(*) FILTER (length(raw) = 1) AS letters, count(*) AS n FROM g GROUP BY 1, 2), k AS (SELECT *, numbers * 1.0 / n AS amount, letters * 1.0 / n AS code FROM s) SELECT sheet, (arg_max(col, (amount, -col)) FILTER (amount > 0.5))::INT AS amount_col, (arg_max(col, (code, -col)) FILTER (code > 0.5))::INT AS code_col FROM k GROUP BY 1")
def i02(t):
    """Which column holds amounts and which codes: the one whose cells look it most, over half of them; the first of equals."""
    c = F.col
    s = grid(t).groupBy("sheet", "col").agg(F.count_if(c("raw").try_cast("double").isNotNull()).alias("numbers"), F.count_if(F.length("raw") == 1).alias("letters"), F.count("*").alias("n"))
    best = lambda x: F.max_by("col", F.when(c(x) / c("n") > 0.5, F.struct((c(x) / c("n")).alias("share"), (-c("col")).alias("first")))).cast("int")
    return s.groupBy("sheet").agg(best("numbers").alias("amount_col"), best("letters").alias("code_col"))


@query("i09_items_first_wins", f"WITH {CELLS} SELECT sheet, strftime(d, '%Y') AS period, (arg_min(abs(cost), r) FILTER (stage = '1-URGENT'))::DOUBLE AS revenue, (arg_min(abs(-cost), r) FILTER (stage = '2-HIGH'))::DOUBLE AS costs FROM cells GROUP BY 1, 2")
def i09(t):
    """Items by period as columns; costs, given as negative, become positive; of several cells the first counts."""
    first = lambda s, sign: dbl(F.min_by(F.abs(F.col("cost") * sign), F.when(F.col("stage") == s, F.col("r"))))
    return cells(t).groupBy("sheet", F.date_format("d", "yyyy").alias("period")).agg(first("1-URGENT", 1).alias("revenue"), first("2-HIGH", -1).alias("costs"))


BLOCKS = "CASE WHEN call_no IS NOT NULL THEN 'call' WHEN investor IS NOT NULL THEN 'commitment' WHEN paid_on IS NOT NULL THEN 'distribution' WHEN left_on IS NOT NULL THEN 'exit' WHEN ledger IS NOT NULL THEN 'ledger' WHEN nav IS NOT NULL THEN 'nav' WHEN budget IS NOT NULL THEN 'budget' WHEN mark IS NOT NULL THEN 'valuation' ELSE 'kpi' END"


@query("i10_row_blocks", f"WITH r AS (SELECT inv_id, n, part_id, payer_id, CASE WHEN n = 1 AND qty > 25 THEN part_id END AS call_no, CASE WHEN n = 1 THEN payer_id END AS investor, CASE WHEN flag = 'R' AND line = 'F' THEN d END AS paid_on, CASE WHEN flag = 'R' THEN d END AS left_on, CASE WHEN flag = 'A' AND qty > 30 THEN gross END AS ledger, CASE WHEN flag = 'A' THEN net END AS nav, CASE WHEN n = 4 THEN gross END AS budget, CASE WHEN n = 5 THEN net END AS mark FROM recv) SELECT {BLOCKS} AS block, count(*) AS n_rows, sum(n)::BIGINT AS lines FROM r GROUP BY 1")
def i10(t):
    """Rows go to the first block whose signature they show; calls before commitments, distributions before exits, the ledger before net asset values."""
    c = F.col
    rungs = [((c("n") == 1) & (c("qty") > 25), "call"), (c("n") == 1, "commitment"), ((c("flag") == "R") & (c("line") == "F"), "distribution"), (c("flag") == "R", "exit"), ((c("flag") == "A") & (c("qty") > 30), "ledger"), (c("flag") == "A", "nav"), (c("n") == 4, "budget"), (c("n") == 5, "valuation")]
    return t.recv.groupBy(ladder([(x, F.lit(b)) for x, b in rungs], F.lit("kpi")).alias("block")).agg(F.count("*").alias("n_rows"), F.sum("n").alias("lines"))


DOMAINS = (("urgent", "calls", 3), ("low", "valuations", 2), ("high", "ledger", 2))


@query("i12_domain_rules", f"WITH {CELLS}, h AS (SELECT sheet, count(*) FILTER (contains(lower(stage), 'urgent')) AS calls, count(*) FILTER (contains(lower(stage), 'low')) AS valuations, count(*) FILTER (contains(lower(stage), 'high')) AS ledger, count(DISTINCT strftime(d, '%Y-%m')) * 1.0 / count(*) AS dated FROM cells GROUP BY 1) SELECT sheet, CASE WHEN calls >= 3 THEN 'calls' WHEN valuations >= 2 THEN 'valuations' WHEN ledger >= 2 THEN 'ledger' WHEN dated >= 1 THEN 'periods' ELSE 'unknown' END AS domain FROM h")
def i12(t):
    """By anchor words, each with the number of hits it takes, in order; then by how dense dates are; else unknown."""
    c = F.col
    hits = [F.count_if(F.lower("stage").contains(w)).alias(d) for w, d, _ in DOMAINS]
    h = cells(t).groupBy("sheet").agg(*hits, (F.count_distinct(F.date_format("d", "yyyy-MM")) / F.count("*")).alias("dated"))
    return h.select("sheet", ladder([*[(c(d) >= k, F.lit(d)) for _, d, k in DOMAINS], (c("dated") >= 1, F.lit("periods"))], F.lit("unknown")).alias("domain"))


@query("i13_backfill_all_sources", f"WITH {KPI}, s AS (SELECT company_id, 0 AS p, 0 AS i, CASE WHEN company_id % 3 = 0 THEN sector ELSE '' END AS v FROM company UNION ALL SELECT company_id, 1, inv_id, CASE WHEN status = 'P' THEN stage ELSE ' ' END FROM inv UNION ALL SELECT company_id, 2, val_id, CASE WHEN val_id % 2 = 0 THEN slug END FROM kpi UNION ALL SELECT company_id, 3, 0, CASE WHEN company_id % 5 <> 0 THEN segment END FROM company) SELECT c.company_id, x.v AS sector FROM company c LEFT JOIN (SELECT company_id, arg_min(trim(v), (p, i)) AS v FROM s WHERE trim(v) <> '' GROUP BY 1) x USING (company_id)")
def i13(t):
    """The first sector that isn't empty, over four sources in order, and within a source in order of rows."""
    c = F.col
    of = lambda df, p, i, v: df.select("company_id", F.lit(p).alias("p"), i.alias("i"), F.trim(v).alias("v"))
    zero = F.lit(0).cast("long")
    s = of(t.company, 0, zero, F.when(c("company_id") % 3 == 0, c("sector"))).unionByName(of(t.inv, 1, c("inv_id"), F.when(c("status") == "P", c("stage")))).unionByName(of(kpi(t), 2, c("val_id"), F.when(c("val_id") % 2 == 0, c("slug")))).unionByName(of(t.company, 3, zero, F.when(c("company_id") % 5 != 0, c("segment"))))
    first = s.filter("v <> ''").groupBy("company_id").agg(F.min_by("v", F.struct("p", "i")).alias("sector"))
    return t.company.select("company_id").join(first, "company_id", "left")


@query("b01_current_access", "WITH u(who, role, fund, until, revoked) AS (VALUES ('ann', 'partner', NULL, NULL, false), ('bob', 'analyst', 'ASIA', DATE '2002-06-30', false), ('bob', 'analyst', 'EUROPE', DATE '2001-06-30', false), ('eve', 'analyst', 'AFRICA', NULL, true), ('joe', 'lp', 'ASIA', NULL, false)), a AS (SELECT who, role, fund FROM u WHERE NOT revoked AND (until IS NULL OR until >= DATE '2001-12-31')) SELECT who, r_name AS fund, role <> 'lp' AS may_edit FROM a JOIN region ON role = 'partner' OR fund = r_name")
def b01(t):
    """Whom a fund is open to: partners see all funds, others those they are granted, while the grant runs and isn't revoked; investors only read."""
    grants = [("ann", "partner", None, None, False), ("bob", "analyst", "ASIA", "2002-06-30", False), ("bob", "analyst", "EUROPE", "2001-06-30", False), ("eve", "analyst", "AFRICA", None, True), ("joe", "lp", "ASIA", None, False)]
    u = t.spark.createDataFrame(grants, "who string, role string, granted string, until string, revoked boolean").filter("not revoked and (until is null or cast(until as date) >= date'2001-12-31')")
    funds = t.region.select(F.col("r_name").alias("fund"))
    every = funds.agg(F.collect_list("fund").alias("all"))  # five names, one row
    seen = u.crossJoin(every).select("who", "role", F.explode(F.when(F.col("role") == "partner", F.col("all")).otherwise(F.filter("all", lambda f: f == F.col("granted")))).alias("fund"))
    return seen.select("who", "fund", (F.col("role") != "lp").alias("may_edit"))


STATEMENT = """'WITH a AS (SELECT * FROM inv), ' || CASE WHEN company_id % 3 = 0 THEN lower(segment) ELSE 'b' END || ' AS (SELECT * FROM ' || replace(lower(fund), ' ', '_') || ') SELECT * FROM a JOIN ' || lower(segment) || CASE WHEN company_id % 2 = 0 THEN ' join B' ELSE ', c' END"""


@query("f12_tables_less_ctes", rf"""WITH s AS (SELECT company_id, lower({STATEMENT}) AS s FROM company), n AS (SELECT company_id, regexp_extract_all(s, '(?:from|join)\s+(\w+)', 1) AS used, regexp_extract_all(s, '(?:with|,)\s*(\w+)\s+as\s*\(', 1) AS made FROM s)
  SELECT company_id, array_to_string(list_sort(list_distinct(list_filter(used, lambda x: NOT list_contains(made, x)))), ',') AS tables FROM n""")
def f12(t):
    """Names that a statement reads less those it defines: a statement a company, with a name that is defined in some and read in others."""
    s = t.company.select("company_id", F.lower(F.expr(STATEMENT)).alias("s"))
    names = lambda rx: F.array_distinct(F.regexp_extract_all("s", F.lit(rx), 1))
    return s.select("company_id", F.array_join(F.array_sort(F.array_except(names(r"(?:from|join)\s+(\w+)"), names(r"(?:with|,)\s*(\w+)\s+as\s*\("))), ",").alias("tables"))


# Fifteen ways to write a day, a spreadsheet's number among them.
WRITTEN_DATES = ("2024-03-31", "31/03/2024", "31-03-2024", "31 Mar 2024", "31-Mar-2024", "31 March 2024", "March 31, 2024", "Mar 31, 2024", "2024/03/31", "20240331", "31.03.2024", "31-Mar-24", "31/03/24", "2024-03-31 00:00:00", "45382", "n/a")
DATE_PATTERNS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd MMM yyyy", "dd-MMM-yyyy", "dd MMMM yyyy", "MMMM dd, yyyy", "MMM dd, yyyy", "yyyy/MM/dd", "yyyyMMdd", "dd.MM.yyyy", "dd-MMM-yy", "dd/MM/yy", "yyyy-MM-dd HH:mm:ss")


@query("h03_fifteen_date_forms", "SELECT val_id, CASE WHEN val_id % 16 < 15 THEN DATE '2024-03-31' END AS d FROM val")
def h03(t):
    """The first form that fits; a number of five digits is a spreadsheet's day."""
    s = F.element_at(F.array(*map(F.lit, WRITTEN_DATES)), (F.col("val_id") % 16 + 1).cast("int"))
    serial = F.when(s.rlike(r"^\d{5}$"), T.serial_date(s.try_cast("int")))
    return t.val.select("val_id", F.coalesce(serial, *[F.try_to_date(s, p) for p in DATE_PATTERNS]).alias("d"))


@query("h04_quarter_labels", "SELECT val_id, CASE val_id % 5 WHEN 0 THEN DATE '2024-04-01' WHEN 1 THEN DATE '2024-07-01' WHEN 2 THEN DATE '2025-10-01' WHEN 3 THEN DATE '2025-01-01' END AS d FROM val")
def h04(t):
    """Quarters of fiscal years begin in April; a quarter of a plain year is the calendar's."""
    s = F.element_at(F.array(*map(F.lit, ("Q1 FY25", "Q3 2024", "q4 2025", "Q4 FY2025", "Q5 2024"))), (F.col("val_id") % 5 + 1).cast("int"))
    plain = r"(?i)^Q([1-4])\s+(\d{4})$"
    of_year = F.when(s.rlike(plain), F.make_date(F.regexp_extract(s, plain, 2).try_cast("int"), F.regexp_extract(s, plain, 1).try_cast("int") * 3 - 2, F.lit(1)))
    return t.val.select("val_id", F.coalesce(of_year, T.period(s)).alias("d"))


HEADERS = ("Mar-25", "FY 2024-25", "Investment ID", "inv_001", "Notes:", "A. Capital calls", "", "Acme Ltd")


@query("h07_four_predicates", "WITH p(i, period, entity, junk, title) AS (VALUES (0, true, false, false, false), (1, true, false, false, false), (2, false, true, false, false), (3, false, true, false, false), (4, false, false, true, false), (5, false, false, false, true), (6, false, false, true, false), (7, false, false, false, false)) SELECT val_id, period, entity, junk, title FROM val JOIN p ON val_id % 8 = i")
def h07(t):
    """What a header cell is: a period, the id of an entity, junk, or the title of a section."""
    s = F.element_at(F.array(*map(F.lit, HEADERS)), (F.col("val_id") % 8 + 1).cast("int"))
    return t.val.select("val_id", T.period(s).isNotNull().alias("period"), F.lower(s).rlike(r"(^|[ _])(id|inv_\d+)$|^inv_\d+$").alias("entity"), ((F.trim(s) == "") | F.lower(s).rlike(r"^(notes?|source|disclaimer)\b.*:?$")).alias("junk"), s.rlike(r"^[A-Z]\. ").alias("title"))


@query("h22_cost_signs", "SELECT inv_id, CASE WHEN stage IN ('2-HIGH', '3-MEDIUM') THEN cost * 100000 ELSE -cost * 100000 END::DOUBLE AS amount FROM inv")
def h22(t):
    """Costs, often given as negative, become positive; what isn't a cost keeps its sign."""
    given = -F.col("cost") * T.unit(F.lit("Rs lakhs")).cast("decimal(12,0)")
    return t.inv.select("inv_id", dbl(F.when(F.col("stage").isin("2-HIGH", "3-MEDIUM"), F.abs(given)).otherwise(given)).alias("amount"))


@query("h25_path_resolver", "SELECT inv_id, sum(gross)::DOUBLE AS summed, (arg_max(net, (d, n, part_id, payer_id)))::DOUBLE AS latest, round(sum(net)::DOUBLE / sum(gross)::DOUBLE, 6) AS computed, (min(gross) FILTER (n = 1))::DOUBLE AS at_path FROM recv GROUP BY 1")
def h25(t):
    """Of a document of lines: the sum over an array, a field of the latest element, a ratio of two sums, and a field of the first line by its number."""
    doc = t.recv.groupBy("inv_id").agg(F.collect_list(F.struct("d", "n", "part_id", "payer_id", "gross", "net")).alias("lines"))  # an investment has a few lines
    exact = lambda f: F.aggregate("lines", F.lit(0).cast("decimal(38,4)"), lambda s, x: (s + x[f]).cast("decimal(38,4)")).cast("double")
    first = F.array_min(F.transform(F.filter("lines", lambda x: x["n"] == 1), lambda x: x["gross"]))
    return doc.select("inv_id", exact("gross").alias("summed"), dbl(F.array_max("lines")["net"]).alias("latest"), F.round(exact("net") / exact("gross"), 6).alias("computed"), dbl(first).alias("at_path"))


@query("h30_display_forms", "WITH x AS (SELECT inv_id, d, ((cost * 100)::BIGINT + 5000000) // 10000000 AS h, (inv_id % 1000 * 10 + 4) // 8 AS p FROM inv) SELECT inv_id, '₹' || (h // 100) || '.' || lpad((h % 100)::VARCHAR, 2, '0') || ' Cr' AS crore, (p // 10) || '.' || (p % 10) || '%' AS pct, strftime(d, '%d %b %Y') AS day FROM x")
def h30(t):
    """Amounts in crore with two digits, shares with one, halves up; days as day, month and year."""
    c = F.col
    shown = F.round(c("cost").cast("decimal(20,2)") * F.lit("0.0000001").cast("decimal(8,7)"), 2)
    share = F.round((c("inv_id") % 1000).cast("decimal(6,0)") * F.lit("0.125").cast("decimal(4,3)"), 1)
    return t.inv.select("inv_id", F.concat(F.lit("₹"), shown.cast("string"), F.lit(" Cr")).alias("crore"), F.concat(share.cast("string"), F.lit("%")).alias("pct"), F.date_format("d", "dd MMM yyyy").alias("day"))


@query("h21_cell_or_not", "WITH p(i, yes) AS (VALUES (0, true), (1, true), (2, true), (3, false), (4, false), (5, false), (6, true)) SELECT val_id, yes AS is_cell FROM val JOIN p ON val_id % 7 = i")
def h21(t):
    raw = ("Sheet1!B12", "'LP Register'!$C$4", "AA7", "computed: sum of B2", "derived from NAV", "page 4", "Calls!C2:C9")
    s = F.element_at(F.array(*map(F.lit, raw)), (F.col("val_id") % 7 + 1).cast("int"))
    return t.val.select("val_id", (s.rlike(r"^([^!]+!)?\$?[A-Z]{1,3}\$?[0-9]+(:\$?[A-Z]{1,3}\$?[0-9]+)?$") & ~s.rlike("computed|derived")).alias("is_cell"))


@query("d21_clean_names_per_sector", "SELECT sector, count(DISTINCT lower(trim(segment))) AS clean, count(DISTINCT segment || CASE company_id % 3 WHEN 0 THEN ' ' ELSE '' END) AS raw FROM company GROUP BY 1")
def d21(t):
    """Companies' names that differ only in case or outer blanks are one."""
    c = F.col
    given = F.concat(F.when(c("company_id") % 2 == 0, F.upper("segment")).otherwise(F.initcap(F.lower("segment"))), F.when(c("company_id") % 3 == 0, " ").otherwise(""))
    spaced = F.concat("segment", F.when(c("company_id") % 3 == 0, " ").otherwise(""))
    return t.company.groupBy("sector").agg(F.count_distinct(F.lower(F.trim(given))).alias("clean"), F.count_distinct(spaced).alias("raw"))


@query("j01_keyless_rows_kept", "WITH e AS (SELECT val_id, CASE WHEN val_id % 4 <> 0 THEN holding_id END AS k, d, CASE WHEN val_id % 2 = 0 THEN fair END AS fair, CASE WHEN val_id % 3 = 0 THEN holding END AS holding FROM val) SELECT k AS holding_id, d, (arg_min(fair, val_id) FILTER (fair IS NOT NULL))::DOUBLE AS fair, (arg_min(holding, val_id) FILTER (holding IS NOT NULL))::DOUBLE AS holding, count(*) AS merged FROM e WHERE k IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT NULL, d, fair::DOUBLE, holding::DOUBLE, 1 FROM e WHERE k IS NULL")
def j01(t):
    """One row a natural key, of each field the first value that is there; rows without a key stay as they are."""
    c = F.col
    e = t.val.select("val_id", F.when(c("val_id") % 4 != 0, c("holding_id")).alias("holding_id"), "d", F.when(c("val_id") % 2 == 0, c("fair")).alias("fair"), F.when(c("val_id") % 3 == 0, c("holding")).alias("holding"))
    first = lambda x: dbl(F.min_by(x, F.when(c(x).isNotNull(), c("val_id")))).alias(x)
    keyed = e.filter("holding_id is not null").groupBy("holding_id", "d").agg(first("fair"), first("holding"), F.count("*").alias("merged"))
    return keyed.unionByName(e.filter("holding_id is null").select("holding_id", "d", dbl("fair").alias("fair"), dbl("holding").alias("holding"), F.lit(1).cast("long").alias("merged")))


SUMS = {"sum_commitments": "sum(cost) * 1.5", "sum_calls": "sum(cost)", "n_investments": "count(*)", "largest": "max(cost)", "mean_cost": "avg(cost::DOUBLE)", "active_cost": "sum(CASE WHEN status = 'O' THEN cost ELSE 0 END)", "exited_cost": "sum(CASE WHEN status = 'F' THEN cost ELSE 0 END)"}


@query("j10_aggregates_of_fund", f"WITH g AS (SELECT fund, {', '.join(f'({x})::DOUBLE AS {n}' for n, x in SUMS.items())} FROM inv JOIN company USING (company_id) GROUP BY 1), r AS (SELECT fund, sum(net)::DOUBLE AS received, sum(CASE WHEN flag = 'R' THEN net ELSE 0 END)::DOUBLE AS capital FROM recv JOIN inv USING (inv_id) JOIN company USING (company_id) GROUP BY 1) SELECT fund, {', '.join(f'round({n}, 2) AS {n}' for n in SUMS)}, round(sum_calls / sum_commitments * 100, 4) AS drawdown_pct, round(capital / sum_calls, 6) AS capital_dpi, round(received / sum_calls, 6) AS dpi FROM g JOIN r USING (fund)")
def j10(t):
    c, s = F.col, F.sum
    per = t.recv.groupBy("inv_id").agg(s("net").alias("net"), s(F.when(c("flag") == "R", c("net")).otherwise(0)).alias("capital"))
    i = t.inv.join(per, "inv_id", "left").groupBy("company_id").agg(s("cost").alias("cost"), F.count("*").alias("n"), F.max("cost").alias("largest"), s(F.when(c("status") == "O", c("cost")).otherwise(0)).alias("active"), s(F.when(c("status") == "F", c("cost")).otherwise(0)).alias("exited"), s("net").alias("net"), s("capital").alias("capital"))
    g = i.join(t.company.select("company_id", "fund"), "company_id").groupBy("fund").agg(*[dbl(s(x)).alias(x) for x in ("cost", "n", "active", "exited", "net", "capital")], dbl(F.max("largest")).alias("largest"))
    two = lambda x, name: F.round(x, 2).alias(name)
    return g.select(
        "fund", two(c("cost") * 1.5, "sum_commitments"), two(c("cost"), "sum_calls"), two(c("n"), "n_investments"), two(c("largest"), "largest"), two(c("cost") / c("n"), "mean_cost"), two(c("active"), "active_cost"), two(c("exited"), "exited_cost"),
        F.round(c("cost") / (c("cost") * 1.5) * 100, 4).alias("drawdown_pct"), F.round(c("capital") / c("cost"), 6).alias("capital_dpi"), F.round(c("net") / c("cost"), 6).alias("dpi"),
    )


PER = f"""{LATEST_VAL}, x AS (SELECT inv_id, sum(net)::DOUBLE AS net FROM recv GROUP BY 1), i AS (SELECT company_id, sum(cost)::DOUBLE AS cost, sum(net) AS got, count(*) AS n, min(d) AS first, bool_and(status = 'F') AS exited FROM inv LEFT JOIN x USING (inv_id) GROUP BY 1), c AS (SELECT company.*, i.cost, got, n, first, coalesce(exited, false) AS exited, lv.fv::DOUBLE * 1000 AS fv, got / nullif(i.cost, 0) AS moic FROM company LEFT JOIN i USING (company_id) LEFT JOIN lv ON holding_id = company_id)"""


def per_company(t) -> DataFrame:
    """Companies with cost, receipts, number of investments, first day, whether all are exited, value and multiple."""
    x = t.recv.groupBy("inv_id").agg(dbl(F.sum("net")).alias("net"))
    i = t.inv.join(x, "inv_id", "left").groupBy("company_id").agg(dbl(F.sum("cost")).alias("cost"), F.sum("net").alias("got"), F.count("*").alias("n"), F.min("d").alias("first"), F.min(F.col("status") == "F").alias("exited"))
    lv = latest_valuation(t).select(F.col("holding_id").alias("company_id"), (dbl("fv") * 1000).alias("fv"))
    c = t.company.join(i, "company_id", "left").join(lv, "company_id", "left").withColumn("exited", F.coalesce("exited", F.lit(False)))
    return c.withColumn("moic", F.try_divide("got", F.nullif("cost", F.lit(0.0))))


def shares(key: str, name: str, sql_key: str):
    """The list by one attribute: count, its share, cost, value, the share of value, mean multiple and rate."""

    @query(name, f"WITH RECURSIVE {PER}, {COMPANY_RATES}, r AS (SELECT company_id, CASE WHEN irr BETWEEN -99.99 AND 999.99 THEN irr::DECIMAL(18,4) END AS irr FROM irr) SELECT {sql_key} AS {key}, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM c), 4)::DOUBLE AS pct_of_count, round(coalesce(sum(cost), 0), 2) AS cost, round(coalesce(sum(fv), 0), 2) AS fv, round(sum(fv) / (SELECT sum(fv) FROM c) * 100, 4) AS pct_of_fv, round(avg(moic), 6) AS mean_moic, round(sum(irr)::DOUBLE / count(irr), 4) AS mean_irr FROM c LEFT JOIN r USING (company_id) GROUP BY 1")
    def f(t):
        c = F.col
        g = per_company(t).join(company_rates(t), "company_id", "left").groupBy(c(sql_key).alias(key)).agg(F.sum(c("irr").cast("decimal(18,4)")).alias("rates"), F.count("irr").alias("rated"), F.count("*").alias("n"), F.sum("cost").alias("cost"), F.sum("fv").alias("fv"), F.avg("moic").alias("m"))
        whole = g.agg(F.sum("n").alias("all_n"), F.sum("fv").alias("all_fv"))
        zero = F.lit(0.0)
        return g.crossJoin(whole).select(key, "n", F.round(c("n") * 100.0 / c("all_n"), 4).alias("pct_of_count"), F.round(F.coalesce("cost", zero), 2).alias("cost"), F.round(F.coalesce("fv", zero), 2).alias("fv"), F.round(F.try_divide("fv", F.nullif("all_fv", zero)) * 100, 4).alias("pct_of_fv"), F.round("m", 6).alias("mean_moic"), ratio("rates", "rated").alias("mean_irr"))  # one row

    return f


shares("sector", "n14_sector_list", "sector")
shares("stage", "n15_stage_list", "segment")
shares("geography", "n16_geography_list", "fund")


@query("n05_fee_figures", f"WITH g AS (SELECT fund, sum(cost)::DOUBLE AS corpus, min(d) AS first FROM inv JOIN company USING (company_id) GROUP BY 1), p AS (SELECT fund, sum(tax) FILTER (flag = 'A')::DOUBLE AS paid, sum(tax) FILTER (flag = 'A' AND year(r.d) = 2000)::DOUBLE AS ytd FROM recv r JOIN inv USING (inv_id) JOIN company USING (company_id) GROUP BY 1) SELECT fund, round(corpus * 0.02 * date_diff('day', first, DATE '{AS_OF}') / 365.25, 2) AS accrued, round(paid, 2) AS paid, round(coalesce(ytd, 0), 2) AS paid_this_year, round(paid * 0.18, 2) AS gst FROM g JOIN p USING (fund)")
def n05(t):
    """Fees accrued on the corpus since the first investment, paid by the ledger, paid in the year, and the tax on them."""
    c = F.col
    per = t.recv.filter("flag = 'A'").groupBy("inv_id").agg(F.sum("tax").alias("paid"), F.sum(F.when(F.year("d") == 2000, c("tax"))).alias("ytd"))
    i = t.inv.join(per, "inv_id", "left").groupBy("company_id").agg(F.sum("cost").alias("cost"), F.min("d").alias("first"), F.sum("paid").alias("paid"), F.sum("ytd").alias("ytd"))
    g = i.join(t.company.select("company_id", "fund"), "company_id").groupBy("fund").agg(dbl(F.sum("cost")).alias("corpus"), F.min("first").alias("first"), dbl(F.sum("paid")).alias("paid"), dbl(F.sum("ytd")).alias("ytd"))
    return g.select("fund", F.round(c("corpus") * 0.02 * F.datediff(F.lit(AS_OF).cast("date"), "first") / 365.25, 2).alias("accrued"), F.round("paid", 2).alias("paid"), F.round(F.coalesce("ytd", F.lit(0.0)), 2).alias("paid_this_year"), F.round(c("paid") * 0.18, 2).alias("gst"))


@query("n06_company_figures", f"WITH {PER} SELECT fund, count(*) FILTER (n > 0) AS companies, round(sum(cost) / nullif(count(*) FILTER (n > 0), 0), 2) AS mean_cost, round(avg(date_diff('day', first, DATE '{AS_OF}')) / 365.25, 4) AS mean_holding_years FROM c GROUP BY 1")
def n06(t):
    """Holding years are from a company's first investment."""
    c = F.col
    g = per_company(t).groupBy("fund").agg(F.count_if(c("n") > 0).alias("companies"), F.sum("cost").alias("cost"), F.avg(F.datediff(F.lit(AS_OF).cast("date"), "first")).alias("days"))
    return g.select("fund", "companies", F.round(F.try_divide("cost", F.nullif(c("companies"), F.lit(0))), 2).alias("mean_cost"), F.round(c("days") / 365.25, 4).alias("mean_holding_years"))


@query("n09_recurring_revenue", f"WITH {KPI}, l AS (SELECT company_id, slug, arg_max(value, (ts, val_id)) AS v FROM kpi WHERE slug IN ('mrr', 'dscr', 'ltv') GROUP BY 1, 2) SELECT fund, round(sum(v) FILTER (slug = 'mrr'), 2) AS mrr, round(sum(v) FILTER (slug = 'mrr') * 12, 2) AS arr, round(avg(v) FILTER (slug = 'dscr'), 4) AS mean_churn, round(avg(v) FILTER (slug = 'ltv'), 4) AS mean_nrr FROM l JOIN company USING (company_id) GROUP BY 1")
def n09(t):
    """Newest reading of each company, then summed or averaged."""
    c = F.col
    l = kpi(t).filter(c("slug").isin("mrr", "dscr", "ltv")).groupBy("company_id", "slug").agg(F.max_by("value", F.struct("ts", "val_id")).alias("v")).join(t.company.select("company_id", "fund"), "company_id")
    of = lambda s: F.when(c("slug") == s, c("v"))
    return l.groupBy("fund").agg(F.round(F.sum(of("mrr")), 2).alias("mrr"), F.round(F.sum(of("mrr")) * 12, 2).alias("arr"), F.round(F.avg(of("dscr")), 4).alias("mean_churn"), F.round(F.avg(of("ltv")), 4).alias("mean_nrr"))


@query("n17_exit_type_list", "SELECT line AS exit_type, count(*) AS n, sum(net)::DOUBLE AS proceeds, round(avg(net::DOUBLE / cost::DOUBLE), 6) AS mean_moic, round(avg(pow(net::DOUBLE / cost::DOUBLE, 365.25 / nullif(date_diff('day', inv.d, r.d), 0)) - 1) * 100, 4) AS mean_irr FROM recv r JOIN inv USING (inv_id) WHERE flag = 'R' AND r.d > inv.d GROUP BY 1")
def n17(t):
    """An exit's rate is the yearly one of a single payment in and a single one out."""
    c = F.col
    r = t.recv.filter("flag = 'R'").select("inv_id", "line", "net", c("d").alias("xd")).join(t.inv.select("inv_id", "cost", "d"), "inv_id").filter("xd > d")
    m = dbl("net") / dbl("cost")
    rate = F.pow(m, F.lit(365.25) / F.datediff("xd", "d")) - 1
    return r.groupBy(c("line").alias("exit_type")).agg(F.count("*").alias("n"), dbl(F.sum("net")).alias("proceeds"), F.round(F.avg(m), 6).alias("mean_moic"), F.round(F.avg(rate) * 100, 4).alias("mean_irr"))


@query("k13_heatmap_three_measures", f"WITH RECURSIVE {PER}, {COMPANY_RATES}, r AS (SELECT holding_id AS company_id, arg_max(fair, (ts, val_id))::DOUBLE AS risk FROM val WHERE methodology = 'error' GROUP BY 1) SELECT c.company_id, round(moic, 4) AS moic, CASE WHEN irr BETWEEN -99.99 AND 999.99 THEN irr END AS irr, coalesce(risk, 50) AS risk, CASE WHEN coalesce(risk, 50) > 66 THEN 'high' WHEN coalesce(risk, 50) > 33 THEN 'medium' ELSE 'low' END AS tier FROM c LEFT JOIN r USING (company_id) LEFT JOIN irr USING (company_id)")
def k13(t):
    """Multiple, dated rate and risk of each company; a company without a score is at 50, medium."""
    c = F.col
    r = t.val.filter("methodology = 'error'").groupBy(c("holding_id").alias("company_id")).agg(dbl(F.max_by("fair", F.struct("ts", "val_id"))).alias("risk"))
    risk = F.coalesce("risk", F.lit(50.0))
    return per_company(t).join(r, "company_id", "left").join(company_rates(t), "company_id", "left").select("company_id", F.round("moic", 4).alias("moic"), "irr", risk.alias("risk"), ladder([(risk > 66, F.lit("high")), (risk > 33, F.lit("medium"))], F.lit("low")).alias("tier"))


@query("p10_moic_buckets_with_exits", f"WITH {PER} SELECT CASE WHEN exited THEN 'exited' WHEN moic >= 2 THEN '2x and more' WHEN moic >= 1 THEN '1x to 2x' WHEN moic >= 0.5 THEN '0.5x to 1x' ELSE 'under 0.5x' END AS bucket, count(*) AS n FROM c WHERE cost > 0 GROUP BY 1")
def p10(t):
    """Companies without cost don't count; those sold in whole are a bucket of their own."""
    c = F.col
    bucket = ladder([(c("exited"), F.lit("exited")), (c("moic") >= 2, F.lit("2x and more")), (c("moic") >= 1, F.lit("1x to 2x")), (c("moic") >= 0.5, F.lit("0.5x to 1x"))], F.lit("under 0.5x"))
    return per_company(t).filter("cost > 0").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("p11_top_companies_moic", f"WITH {PER} SELECT company_id, fv, round(fv / nullif(cost, 0), 6) AS moic FROM c WHERE fv IS NOT NULL ORDER BY fv DESC, company_id LIMIT 10")
def p11(t):
    """The ten of most value, with their multiples; a top list by definition."""
    return per_company(t).filter("fv is not null").orderBy(F.desc("fv"), "company_id").limit(10).select("company_id", "fv", ratio("fv", "cost", 6).alias("moic"))


@query("p12_allocation_three_ways", f"WITH {PER} SELECT sector, count(*) AS n, round(coalesce(sum(cost), 0), 2) AS cost, round(coalesce(sum(fv), 0), 2) AS fv, CASE WHEN sum(fv) > 0 THEN 'fv' WHEN sum(cost) > 0 THEN 'cost' ELSE 'count' END AS basis FROM c GROUP BY 1")
def p12(t):
    """A sector's share goes by value if it has any, else by cost, else by number."""
    c = F.col
    g = per_company(t).groupBy("sector").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.sum("fv").alias("fv"))
    return g.select("sector", "n", F.round(F.coalesce("cost", F.lit(0.0)), 2).alias("cost"), F.round(F.coalesce("fv", F.lit(0.0)), 2).alias("fv"), ladder([(c("fv") > 0, F.lit("fv")), (c("cost") > 0, F.lit("cost"))], F.lit("count")).alias("basis"))


@query("p09_cascade_delete", "WITH gone AS (SELECT inv_id, company_id FROM inv JOIN company USING (company_id) WHERE fund = 'ASIA' AND status = 'P'), kept AS (SELECT * FROM inv ANTI JOIN gone USING (inv_id)) SELECT 'investments' AS kind, count(*) AS deleted, (SELECT count(*) FROM kept) AS kept FROM gone UNION ALL SELECT 'receipts', count(*) FILTER (inv_id IN (SELECT inv_id FROM gone)), count(*) FILTER (inv_id NOT IN (SELECT inv_id FROM gone)) FROM recv UNION ALL SELECT 'companies', count(DISTINCT company_id) FILTER (company_id NOT IN (SELECT company_id FROM kept)), count(DISTINCT company_id) FILTER (company_id IN (SELECT company_id FROM kept)) FROM inv")
def p09(t):
    """What deleting an import takes along: its investments, their receipts, and the companies that nothing else refers to."""
    asia = t.company.filter("fund = 'ASIA'").select("company_id")
    marked = t.inv.join(asia.withColumn("asia", F.lit(True)), "company_id", "left").withColumn("gone", F.coalesce(F.col("asia") & (F.col("status") == "P"), F.lit(False)))
    told = lambda df, kind: df.agg(F.count_if("gone").alias("deleted"), F.count_if(~F.col("gone")).alias("kept")).select(F.lit(kind).alias("kind"), "deleted", "kept")
    r = t.recv.select("inv_id").join(marked.select("inv_id", "gone"), "inv_id")
    return told(marked, "investments").unionByName(told(r, "receipts")).unionByName(told(marked.groupBy("company_id").agg(F.min("gone").alias("gone")), "companies"))


MOVES = (("valuation", "draft", "approved"), ("kpi", "submitted", "reviewed"), ("kyc", "pending", "verified"), ("distribution", "declared", "paid"), ("call", "issued", "paid"))


@query("p20_status_transitions", "WITH e AS (SELECT inv_id, ['valuation', 'kpi', 'kyc', 'distribution', 'call'][inv_id % 5 + 1] AS kind, CASE WHEN status = 'F' THEN 'done' WHEN status = 'P' THEN 'blocked' ELSE 'open' END AS state FROM inv), l AS (SELECT inv_id, bool_and(flag <> 'N') AS all_paid FROM recv GROUP BY 1) SELECT inv_id, kind, CASE WHEN state = 'blocked' THEN 'unchanged' WHEN kind = 'call' THEN CASE WHEN coalesce(all_paid, false) THEN 'paid' ELSE 'issued' END WHEN state = 'done' THEN 'unchanged' ELSE CASE kind WHEN 'valuation' THEN 'approved' WHEN 'kpi' THEN 'reviewed' WHEN 'kyc' THEN 'verified' ELSE 'paid' END END AS status FROM e LEFT JOIN l USING (inv_id)")
def p20(t):
    """An open record moves on by its kind; a call is paid when all its lines are, and only if it has any."""
    c = F.col
    kind = F.element_at(F.array(*[F.lit(k) for k, _, _ in MOVES]), (c("inv_id") % 5 + 1).cast("int"))
    lines = t.recv.groupBy("inv_id").agg(F.min(c("flag") != "N").alias("all_paid"))
    j = t.inv.select("inv_id", "status", kind.alias("kind")).join(lines, "inv_id", "left")
    called = F.when(F.coalesce("all_paid", F.lit(False)), "paid").otherwise("issued")
    return j.select("inv_id", "kind", ladder([(c("status") == "P", F.lit("unchanged")), (c("kind") == "call", called), (c("status") == "F", F.lit("unchanged")), *[(c("kind") == k, F.lit(to)) for k, _, to in MOVES[:4]]], F.lit(None)).alias("status"))
