"""Header binding of sheets and routing of their rows to blocks (inventory I02, H07 and I10).

A sheet is a set of cells (sheet, row, col, raw, kind), kind being text, number or date; empty cells may be missing. All steps are joins and aggregates by sheet, so any number
of sheets goes through one plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.staging import staged
from .fundframe import ladder
from .records import CELLS, cells

# What tells a junk row, an entity's number, a period and a period's column.
JUNK = r"^(grand\s*)?(sub[\s\-]*)?total\s*[:\-]?\s*$|^cumulative\s*total|^total\s+(called|exits|distributions|investors|lps|committed|drawdown)\b|^totals?\s*[:\-]?\s*$|^notes?\s*[:\-\(]|^summary\s*[:\-]?\s*$|^disclaimer|^important\s*[:\-]|^\*+"
NUMBERED = r"^(lp|pc|inv|co|d|cc|f\d*c)\-?\d+$"
PERIOD = r"(?i)^(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*[\s\-/]?\d{2,4}|q[1-4][\s\-/]?(?:fy)?\s*\d{2,4}|fy\s*\d{2,4}(?:[\s\-/]\d{2,4})?|\d{4}[\s\-/]\d{1,2}|\d{4})$|^(?:fy\s?\d{2,4}|q[1-4](?:\s?fy\s?\d{2,4})?)|^\d{4}[-/]\d{1,2}(?:[-/]\d{1,2})?$"
PERIOD_WORDS = ("period", "quarter", "fiscal year", "financial year", "reporting period", "as of", "as at", "as-at", "as-of", "fy", "month", "date", "year", "nav date", "valuation date", "reporting date")
DATED = ("period", "nav_date", "investment_date", "valuation_date", "call_date", "distribution_date", "exit_date", "financial_year")
#: Rows that are looked at for a header, rows below it that are sampled from, samples, and columns whose samples may look like periods.
HEADER_ROWS, BELOW, SAMPLES, NEAR = 20, 7, 3, 6

#: Fields that a sheet of investments may have, with the names they go by; the second table is what somebody guessed of single headers.
ALIASES = (("company_name", "company name"), ("company_name", "portfolio company"), ("company_name", "investee company"), ("company_id", "company id"), ("company_id", "company code"), ("total_invested", "amount invested"), ("total_invested", "total invested"), ("investment_date", "investment date"), ("investment_date", "date of investment"), ("sector", "sector"), ("financial_year", "fy"), ("financial_year", "financial year"), ("period", "reporting period"))
GUESSES = (("entity", "company_name"), ("investee", "company_name"), ("ticket", "total_invested"), ("sector", "company_name"), ("invested", "total_invested"), ("remarks", "company_id"), ("as of", "company_id"))
HEADERS = (
    ("Company Name", "Company ID", "Amount Invested (Cr)", "Investment Date", "FY", "Quarter", "Remarks/month"),
    ("Company  Name", "Company Name", "Total-Invested", "Date of Investment", "FY", "Reporting Period", "Sector"),
    ("Entity", "Investee", "Ticket", "Investment Date", "Financial Year", "Label", "Notes"),
    ("Sector", "Portfolio Company", "Invested", "Opened", "", "As of", "Remarks"),
)


def alias_forms(x: Column) -> tuple[Column, Column]:
    """Lower case without what stands in parentheses, units and marks: with blanks, and without."""
    s = F.regexp_replace(F.lower(x), r"\([^)]*\)", " ")
    s = F.regexp_replace(s, r"/\s*(mo|month|yr|year|qtr|quarter|day|week|wk)\b", " ")
    s = F.trim(F.regexp_replace(s, r"[^a-z0-9]+", " "))
    return s, F.regexp_replace(s, " ", "")


def alias_index(aliases: DataFrame) -> DataFrame:
    """aliases(canon, alias) to form and canon: a field's own name keeps its form, then the first field by name does."""
    own = aliases.select("canon", F.regexp_replace("canon", "_", " ").alias("alias"), F.lit(0).alias("rank")).unionByName(aliases.select("canon", "alias", F.lit(1).alias("rank")))
    forms = own.select("canon", "rank", F.explode(F.array(*alias_forms(F.col("alias")))).alias("form")).filter("form <> ''")
    return forms.groupBy("form").agg(F.min_by("canon", F.struct("rank", "canon")).alias("canon"))


def row_facts(grid: DataFrame) -> DataFrame:
    """sheet, row, texts (text cells), n (cells), junk and title of each row that has a cell."""
    c = F.col
    g = grid.filter("trim(raw) <> ''")
    rows = g.groupBy("sheet", "row").agg(F.count("*").alias("n"), F.count_if(c("kind") == "text").alias("texts"), F.min_by(F.trim("raw"), "col").alias("head"), F.min_by("kind", "col").alias("head_kind"))
    title = (c("n") == 1) & (c("head_kind") == "text") & (F.length("head") <= 120) & c("head").rlike("[a-z]")
    return rows.select("sheet", "row", "n", "texts", F.lower("head").rlike(JUNK).alias("junk"), title.alias("title"))


def header_rows(facts: DataFrame) -> DataFrame:
    """sheet and header: of the first rows the first of those with most text cells, three at least."""
    top = facts.filter((F.col("row") < HEADER_ROWS) & (F.col("texts") >= 3))
    return top.groupBy("sheet").agg(F.max_by("row", F.struct("texts", -F.col("row"))).alias("header"))


def bound(grid: DataFrame, aliases: DataFrame, guesses: DataFrame) -> DataFrame:
    """grid, aliases(canon, alias) and guesses(header, canon) to sheet, header, canon and col.

    A header that somebody guessed is a candidate for the guessed field, any other for the field whose alias it is. An alias is exact: its first column wins over guesses. Of
    several guesses the column wins whose samples look most like names, or least so for numbers of things. At last a column of periods that tells
    the sampled rows apart better than what is bound as a date becomes the period.
    """
    c = F.col
    facts = row_facts(grid)
    heads = header_rows(facts)
    g = grid.filter("trim(raw) <> ''").join(heads, "sheet")
    text = F.trim(F.regexp_replace(F.lower("raw"), r"\s+", " "))
    space, compact = alias_forms(c("raw"))
    header = g.filter("row = header").select("sheet", "col", text.alias("key"), space.alias("space"), compact.alias("compact"))
    index = alias_index(aliases)
    by = lambda form, name: index.select(c("form").alias(form), c("canon").alias(name))
    header = header.join(guesses.select(c("header").alias("key"), c("canon").alias("guess")), "key", "left").join(by("space", "alias1"), "space", "left").join(by("compact", "alias2"), "compact", "left")
    named = header.select("sheet", "col", "key", F.coalesce("guess", "alias1", "alias2").alias("canon"), c("guess").isNull().alias("exact"))
    # Samples: the first three rows below that aren't junk.
    below = facts.join(heads, "sheet").filter((c("row") > c("header")) & (c("row") <= c("header") + BELOW) & ~c("junk"))
    three = below.groupBy("sheet").agg(F.slice(F.array_sort(F.collect_list("row")), 1, SAMPLES).alias("rows"))  # seven rows at most
    s = F.trim("raw")
    own = 1 + F.least(F.floor(F.length(s) / 10), F.lit(5)) + F.when(s.contains(" "), 3).otherwise(0) - F.when(F.lower(s).rlike(NUMBERED), 5).otherwise(0)
    sampled = g.join(three, "sheet").filter(F.array_contains("rows", c("row")))
    scores = sampled.groupBy("sheet", "col").agg(F.sum(own).alias("score"), F.count_distinct(s).alias("distinct"), F.count_if((c("kind") == "date") | s.rlike(PERIOD)).alias("periods"))
    named = named.join(scores, ["sheet", "col"], "left").withColumn("score", F.coalesce("score", F.lit(0)))
    is_id = c("canon").endswith("_id")
    rank = F.struct((~c("exact")).alias("a"), F.when(c("exact"), 0).when(is_id, c("score")).otherwise(-c("score")).alias("b"), c("col").alias("c"))
    chosen = named.filter("canon is not null").groupBy("sheet", "canon").agg(F.min_by("col", rank).alias("col"))
    # The period: the first header that names one, else the first of the near columns that holds two.
    word = reduce(lambda a, b: a | b, [c("key").contains(w) for w in PERIOD_WORDS])
    found = named.groupBy("sheet").agg(F.min(F.when(word, c("col"))).alias("by_name"))
    held = scores.filter((c("col") < NEAR) & (c("periods") >= 2)).groupBy("sheet").agg(F.min("col").alias("by_value"))
    order = F.array_position(F.array(*map(F.lit, DATED)), c("canon"))
    dated = chosen.filter(c("canon").isin(*DATED)).groupBy("sheet").agg(F.min_by("col", order).alias("now"))
    found = found.join(held, "sheet", "left").join(dated, "sheet", "left").select("sheet", F.coalesce("by_name", "by_value").alias("col"), "now").filter("col is not null and not (now <=> col)")
    fineness = lambda name: scores.select("sheet", c("col").alias(name), c("distinct").alias(f"{name}_n"))
    finer = found.join(fineness("col"), ["sheet", "col"], "left").join(fineness("now"), ["sheet", "now"], "left").filter(F.coalesce("col_n", F.lit(0)) > F.coalesce("now_n", F.lit(0)))
    finer = finer.select("sheet", F.lit("period").alias("canon"), c("col").alias("finer"))
    both = chosen.join(finer, ["sheet", "canon"], "full").select("sheet", "canon", F.coalesce("finer", "col").alias("col"))
    # A sheet of which nothing but a period was found by its values isn't bound at all only if nothing is.
    return both.join(heads, "sheet").select("sheet", "header", "canon", "col")


def extracted(grid: DataFrame, columns: DataFrame, fields: list[str]) -> DataFrame:
    """The rows below the header, neither junk nor a title, as sheet, row and the bound fields' texts; rows without any are left out."""
    facts = row_facts(grid).filter("not junk and not title").select("sheet", "row")
    met = grid.filter("trim(raw) <> ''").join(columns, ["sheet", "col"]).filter("row > header").join(facts, ["sheet", "row"])
    return met.groupBy("sheet", "row").pivot("canon", fields).agg(F.max(F.trim("raw")))


def investment_grid(t) -> DataFrame:
    """Sheets of investments, one a company: two title rows at most, a header in one of four ways, shifted by a column or two, then a row an investment with totals among them."""
    c = F.col
    base = cells(t)
    q = F.concat(F.lit("Q"), F.quarter("d").cast("string"), F.lit(" FY"), F.year("d").cast("string"))
    values = [
        (F.concat(F.lit("Fund "), c("stage"), F.lit(" Holdings")), "text"), (F.concat(F.lit("PC-"), c("inv_id").cast("string")), "text"), (F.when(c("inv_id") % 11 != 0, c("cost").cast("string")), "number"), (c("d").cast("string"), "date"),
        (F.concat(F.lit("FY"), F.year("d").cast("string")), "text"), (q, "text"), (F.when(c("inv_id") % 3 == 0, c("status")).otherwise(""), "text"),
    ]
    junk = c("r") % 5 == 4
    row, shift = c("r") + c("sheet") % 3, c("sheet") % 3
    data = [F.struct(row.alias("row"), (shift + j).alias("col"), F.when(junk, F.lit("Total" if j == 0 else None)).otherwise(v).alias("raw"), F.lit(k).alias("kind")) for j, (v, k) in enumerate(values)]
    body = base.select("sheet", F.explode(F.array(*data)).alias("x")).select("sheet", "x.*")
    once = base.filter("r = 1").select("sheet", shift.alias("shift"))
    heads = F.array(*[F.array(*map(F.lit, h)) for h in HEADERS])
    header = once.select("sheet", "shift", F.posexplode(F.element_at(heads, (c("sheet") % 4 + 1).cast("int"))).alias("j", "raw")).select("sheet", c("shift").alias("row"), (c("shift") + c("j")).alias("col"), "raw", F.lit("text").alias("kind"))
    title = once.select("sheet", F.explode(F.when(c("shift") > 0, F.sequence(F.lit(0).cast("long"), c("shift") - 1)).otherwise(F.array().cast("array<bigint>"))).alias("row")).select("sheet", "row", F.lit(0).cast("long").alias("col"), F.lit("Schedule of Investments").alias("raw"), F.lit("text").alias("kind"))
    return body.unionByName(header).unionByName(title).filter("raw is not null")


def listed(names: tuple) -> str:
    return ", ".join(str(x) for x in names)


SHEETS = f"""{CELLS}, b AS (SELECT sheet, r + sheet % 3 AS row, sheet % 3 AS shift, r % 5 = 4 AS junk, stage, inv_id, cost, d, status FROM cells),
g AS (SELECT * FROM (
  SELECT sheet, row, shift AS col, CASE WHEN junk THEN 'Total' ELSE 'Fund ' || stage || ' Holdings' END AS raw, 'text' AS kind FROM b UNION ALL SELECT sheet, row, shift + 1, CASE WHEN NOT junk THEN 'PC-' || inv_id END, 'text' FROM b
  UNION ALL SELECT sheet, row, shift + 2, CASE WHEN NOT junk AND inv_id % 11 <> 0 THEN cost::VARCHAR END, 'number' FROM b UNION ALL SELECT sheet, row, shift + 3, CASE WHEN NOT junk THEN d::VARCHAR END, 'date' FROM b
  UNION ALL SELECT sheet, row, shift + 4, CASE WHEN NOT junk THEN 'FY' || year(d) END, 'text' FROM b UNION ALL SELECT sheet, row, shift + 5, CASE WHEN NOT junk THEN 'Q' || quarter(d) || ' FY' || year(d) END, 'text' FROM b
  UNION ALL SELECT sheet, row, shift + 6, CASE WHEN NOT junk AND inv_id % 3 = 0 THEN status END, 'text' FROM b
  UNION ALL SELECT sheet, shift, shift + j - 1, ({[list(h) for h in HEADERS]!r})[(sheet % 4 + 1)::INT][j::INT], 'text' FROM (SELECT DISTINCT sheet, shift FROM b), generate_series(1, 7) s(j)
  UNION ALL SELECT sheet, k, 0, 'Schedule of Investments', 'text' FROM (SELECT DISTINCT sheet, shift FROM b), generate_series(0, 1) s(k) WHERE k < shift) WHERE trim(raw) <> ''),
facts AS (SELECT sheet, row, n, texts, regexp_matches(lower(head), '{JUNK}') AS junk, n = 1 AND head_kind = 'text' AND length(head) <= 120 AND regexp_matches(head, '[a-z]') AS title FROM (SELECT sheet, row, count(*) AS n, count(*) FILTER (kind = 'text') AS texts, arg_min(trim(raw), col) AS head, arg_min(kind, col) AS head_kind FROM g GROUP BY 1, 2)),
heads AS (SELECT sheet, arg_max(row, (texts, -row)) AS header FROM facts WHERE row < {HEADER_ROWS} AND texts >= 3 GROUP BY 1),
al(canon, alias) AS (VALUES {listed(ALIASES)}), gu(header, canon) AS (VALUES {listed(GUESSES)}),
forms AS (SELECT canon, rank, unnest([s, replace(s, ' ', '')]) AS form FROM (SELECT canon, rank, trim(regexp_replace(regexp_replace(regexp_replace(lower(alias), '\\([^)]*\\)', ' ', 'g'), '/\\s*(mo|month|yr|year|qtr|quarter|day|week|wk)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS s FROM (SELECT canon, replace(canon, '_', ' ') AS alias, 0 AS rank FROM al UNION ALL SELECT canon, alias, 1 FROM al))),
ix AS (SELECT form, arg_min(canon, (rank, canon)) AS canon FROM forms WHERE form <> '' GROUP BY 1),
hd AS (SELECT g.sheet, col, trim(regexp_replace(lower(raw), '\\s+', ' ', 'g')) AS key, trim(regexp_replace(regexp_replace(regexp_replace(lower(raw), '\\([^)]*\\)', ' ', 'g'), '/\\s*(mo|month|yr|year|qtr|quarter|day|week|wk)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS space FROM g JOIN heads USING (sheet) WHERE row = header),
smp AS (SELECT sheet, row FROM (SELECT f.sheet, row, row_number() OVER (PARTITION BY f.sheet ORDER BY row) AS k FROM facts f JOIN heads USING (sheet) WHERE row > header AND row <= header + {BELOW} AND NOT junk) WHERE k <= {SAMPLES}),
sc AS (SELECT sheet, col, sum(1 + least(length(trim(raw)) // 10, 5) + CASE WHEN contains(trim(raw), ' ') THEN 3 ELSE 0 END - CASE WHEN regexp_matches(lower(trim(raw)), '{NUMBERED}') THEN 5 ELSE 0 END) AS score, count(DISTINCT trim(raw)) AS fine, count(*) FILTER (kind = 'date' OR regexp_matches(trim(raw), '{PERIOD}')) AS periods FROM g JOIN smp USING (sheet, row) GROUP BY 1, 2),
nm AS (SELECT hd.sheet, hd.col, key, coalesce(gu.canon, i1.canon, i2.canon) AS canon, gu.canon IS NULL AS exact, coalesce(score, 0) AS score FROM hd LEFT JOIN gu ON gu.header = key LEFT JOIN ix i1 ON i1.form = space LEFT JOIN ix i2 ON i2.form = replace(space, ' ', '') LEFT JOIN sc USING (sheet, col)),
ch AS (SELECT sheet, canon, coalesce(min(col) FILTER (exact), CASE WHEN canon LIKE '%\\_id' ESCAPE '\\' THEN arg_min(col, (score, col)) ELSE arg_max(col, (score, -col)) END) AS col FROM nm WHERE canon IS NOT NULL GROUP BY 1, 2),
pd AS (SELECT n.sheet, coalesce(by_name, by_value) AS col, now FROM (SELECT sheet, min(col) FILTER ({' OR '.join(f"contains(key, '{w}')" for w in PERIOD_WORDS)}) AS by_name FROM nm GROUP BY 1) n LEFT JOIN (SELECT sheet, min(col) AS by_value FROM sc WHERE col < {NEAR} AND periods >= 2 GROUP BY 1) USING (sheet)
  LEFT JOIN (SELECT sheet, arg_min(col, list_position({list(DATED)!r}, canon)) AS now FROM ch WHERE canon IN {DATED!r} GROUP BY 1) USING (sheet)),
fn AS (SELECT pd.sheet, pd.col FROM pd LEFT JOIN sc a ON a.sheet = pd.sheet AND a.col = pd.col LEFT JOIN sc b ON b.sheet = pd.sheet AND b.col = pd.now WHERE pd.col IS NOT NULL AND pd.col IS DISTINCT FROM pd.now AND coalesce(a.fine, 0) > coalesce(b.fine, 0)),
bd AS (SELECT sheet, header, canon, col FROM (SELECT sheet, canon, col FROM ch WHERE NOT (canon = 'period' AND sheet IN (SELECT sheet FROM fn)) UNION ALL SELECT sheet, 'period', col FROM fn) JOIN heads USING (sheet))"""
FIELDS = ["company_name", "company_id", "total_invested", "investment_date", "sector", "financial_year", "period"]


def investment_columns(t, grid: DataFrame) -> DataFrame:
    make = t.spark.createDataFrame
    return bound(grid, make(ALIASES, "canon string, alias string"), make(GUESSES, "header string, canon string"))


@query("i02_bound_columns", f"WITH {SHEETS} SELECT sheet, header, canon, col FROM bd")
def i02_columns(t):
    """Which column of each sheet holds which field."""
    return investment_columns(t, investment_grid(t))


@query("i02_header_binding", f"WITH {SHEETS} SELECT sheet, row, {', '.join(f'max(trim(raw)) FILTER (canon = {f!r}) AS {f}' for f in FIELDS)} FROM g JOIN bd USING (sheet, col) JOIN facts f USING (sheet, row) WHERE row > header AND NOT f.junk AND NOT f.title GROUP BY 1, 2")
def i02_rows(t):
    """The sheets' rows by the fields that their columns were bound to."""
    grid = staged(investment_grid(t))
    return extracted(grid, investment_columns(t, grid), FIELDS)


# What is a period's header, and what is the number of a company, an investor or an investment.
PERIOD_HEADER = r"(?i)^(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*[\s\-/]?\d{2,4}|q[1-4][\s\-/]?(?:fy)?\s*\d{2,4}|fy\s*\d{2,4}(?:[\s\-/]\d{2,4})?|\d{4}[\s\-/]\d{1,2}|\d{4})$"
ENTITY_HEADER = r"(?i)^\s*(?:lp|inv|pc|co|entity|acct|account|f\d*c)[\s_\-]*(\d+|[a-z]\d+|[ivx]+)(?:\s*\([^)]*\))?\s*$"
MADE = """CASE inv_id % 14 WHEN 0 THEN 'LP' || company_id WHEN 1 THEN 'PC-' || inv_id || ' (x)' WHEN 2 THEN ' f14c' || company_id WHEN 3 THEN 'Q' || (inv_id % 6) || '-' || (20 + company_id % 9) WHEN 4 THEN 'fy ' || (2010 + inv_id % 20) || '-' || (11 + inv_id % 20) WHEN 5 THEN stage WHEN 6 THEN 'Total ' || CASE WHEN company_id % 2 = 0 THEN 'investors' ELSE stage END
  WHEN 7 THEN 'Note: ' || status WHEN 8 THEN (2000 + company_id % 99) || '/' || (inv_id % 13) WHEN 9 THEN 'Sub-Total:' WHEN 10 THEN 'INV ' || status || ' (' || stage || ')' WHEN 11 THEN 'A. ' || lower(stage) WHEN 12 THEN 'Sept' || (company_id % 100) ELSE 'account iv' END"""


@query("h07_predicates_of_cells", f"WITH m AS (SELECT inv_id, {MADE} AS raw, inv_id % 3 = 0 AS beside FROM inv) SELECT inv_id, regexp_matches(trim(raw), '{PERIOD_HEADER}') AS is_period, regexp_matches(trim(raw), '{ENTITY_HEADER}') AS is_entity, regexp_matches(lower(trim(raw)), '{JUNK}') AS junk, NOT beside AND length(trim(raw)) <= 120 AND regexp_matches(raw, '[a-z]') AS title FROM m")
def h07(t):
    """Of every cell whether it is a period's header, an entity's number, the head of a junk row, or a title that stands alone in its row."""
    c = F.col
    m = t.inv.select("inv_id", "company_id", "stage", "status").withColumn("raw", F.expr(MADE))
    cells_ = m.select(c("inv_id").alias("sheet"), F.lit(0).alias("row"), F.lit(0).alias("col"), "raw", F.lit("text").alias("kind"))
    beside = m.filter("inv_id % 3 = 0").select(c("inv_id").alias("sheet"), F.lit(0).alias("row"), F.lit(1).alias("col"), F.lit("1").alias("raw"), F.lit("number").alias("kind"))
    facts = row_facts(cells_.unionByName(beside)).select(c("sheet").alias("inv_id"), "junk", "title")
    s = F.trim("raw")
    return m.join(facts, "inv_id").select("inv_id", s.rlike(PERIOD_HEADER).alias("is_period"), s.rlike(ENTITY_HEADER).alias("is_entity"), "junk", "title")
