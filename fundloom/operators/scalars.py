"""Scalar functions applied to the tables (inventory H)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..sources.tables import dbl


@query("h01_number_cells", """SELECT inv_id, CASE inv_id % 5 WHEN 0 THEN cost::DOUBLE WHEN 1 THEN -(cost::DOUBLE) WHEN 2 THEN cost::DOUBLE WHEN 3 THEN NULL ELSE inv_id % 90 END AS amount FROM inv""")
def h01(t):
    """Cells are written in five ways and read back: plain, (negative), with currency and unit, no value, percent."""
    c = F.col("cost").cast("string")
    k = F.col("inv_id") % 5
    raw = F.when(k == 0, c).when(k == 1, F.concat(F.lit("("), c, F.lit(")"))).when(k == 2, F.concat(F.lit("Rs "), F.format_number(dbl("cost"), 2), F.lit(" Cr"))).when(k == 3, "N/A").otherwise(F.concat((F.col("inv_id") % 90).cast("string"), F.lit(" %")))
    return t.inv.select("inv_id", T.number(raw).alias("amount"))


@query("h03_dates", "SELECT inv_id, CASE WHEN inv_id % 4 = 3 THEN date_trunc('month', d)::DATE ELSE d END AS read_back FROM inv")
def h03(t):
    k = F.col("inv_id") % 4
    raw = F.when(k == 0, F.date_format("d", "yyyy-MM-dd")).when(k == 1, F.date_format("d", "dd/MM/yyyy")).when(k == 2, F.date_format("d", "dd-MMM-yyyy")).otherwise(F.date_format("d", "MMM yyyy"))
    return t.inv.select("inv_id", T.date(raw).alias("read_back"))


@query("h04_period_labels", """SELECT inv_id, CASE inv_id % 4 WHEN 0 THEN make_date(CASE WHEN month(d) >= 4 THEN year(d) ELSE year(d) - 1 END, 4, 1) WHEN 1 THEN date_trunc('quarter', d)::DATE WHEN 2 THEN date_trunc('month', d)::DATE ELSE make_date(year(d), 4, 1) END AS starts FROM inv WHERE d >= DATE '2000-04-01'""")
def h04(t):
    k, fy = F.col("inv_id") % 4, T.fiscal_year(F.col("d"))
    two = lambda y: F.lpad((y % 100).cast("string"), 2, "0")
    raw = F.when(k == 0, F.concat(F.lit("FY "), (fy - 1).cast("string"), F.lit("-"), two(fy))).when(k == 1, F.concat(F.lit("Q"), T.fiscal_quarter(F.col("d")).cast("string"), F.lit(" FY"), two(fy))).when(k == 2, F.date_format("d", "yyyy-MM")).otherwise(F.year("d").cast("string"))
    return t.inv.filter("d >= date'2000-04-01'").select("inv_id", T.period(raw).alias("starts"))


@query("h06_fiscal_quarters", "SELECT inv_id, 'Q' || ((month(d) + 8) % 12 // 3 + 1) || ' FY' || CASE WHEN month(d) >= 4 THEN year(d) + 1 ELSE year(d) END AS fq, date_trunc('quarter', d)::DATE AS q_start, (date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS q_end FROM inv")
def h06(t):
    start = F.trunc("d", "quarter")
    name = F.concat(F.lit("Q"), T.fiscal_quarter(F.col("d")).cast("string"), F.lit(" FY"), T.fiscal_year(F.col("d")).cast("string"))
    return t.inv.select("inv_id", name.alias("fq"), start.alias("q_start"), F.date_sub(F.add_months(start, 3), 1).alias("q_end"))


@query("h07_header_predicates", "SELECT p_partkey AS part_id, regexp_matches(p_name, '^(small|red|blue)') AS is_title, regexp_matches(p_brand, '[0-9]{2}$') AS is_period, lower(p_type) IN ('economy', 'promo') AS is_junk FROM part")
def h07(t):
    return t.part.select(F.col("p_partkey").alias("part_id"), F.col("p_name").rlike("^(small|red|blue)").alias("is_title"), F.col("p_brand").rlike("[0-9]{2}$").alias("is_period"), F.lower("p_type").isin("economy", "promo").alias("is_junk"))


@query("h08_slug", "SELECT company_id, regexp_replace(regexp_replace(lower(company || ' / ' || segment || '!'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM company")
def h08(t):
    return t.company.select("company_id", T.slug(F.concat("company", F.lit(" / "), "segment", F.lit("!"))).alias("slug"))


@query("h09_entity_name", "SELECT company_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(company || ' Pvt. Ltd. (' || segment || ')'), '[.,''()&#]', ' ', 'g'), '\\b(private|pvt|limited|ltd|llp|inc|plc|corp|company|co)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS entity FROM company")
def h09(t):
    return t.company.select("company_id", T.entity(F.concat("company", F.lit(" Pvt. Ltd. ("), "segment", F.lit(")"))).alias("entity"))


@query("h01_prefixed_numbers", "WITH x(i, v) AS (VALUES (0, 12.5::DOUBLE), (1, 1200), (2, -3.5), (3, 45382), (4, 7), (5, NULL), (6, 5), (7, 500)) SELECT val_id, v AS value FROM val JOIN x ON val_id % 8 = i")
def h01_prefixed(t):
    """Describing words, currencies and units are dropped; a day of the years 1900 or 1901 is a number that a sheet took for a day."""
    given = ("Approx. Rs 12.5 Cr", "about USD 1,200", "(3.5)", "45382", "up to 7 %", "TBD", "1900-01-04", "1901-05-14")
    s = F.element_at(F.array(*map(F.lit, given)), (F.col("val_id") % 8 + 1).cast("int"))
    day = F.try_to_date(s, "yyyy-MM-dd")
    serial = F.when(F.year(day).isin(1900, 1901), F.datediff(day, F.lit("1899-12-30").cast("date")).cast("double"))
    return t.val.select("val_id", F.coalesce(serial, T.number(s)).alias("value"))


@query("h09_names_with_marks", "WITH x(i, e) AS (VALUES (0, 'a b'), (1, 'a b'), (2, 'acme'), (3, 'acme'), (4, 'x y z')) SELECT val_id, e AS entity FROM val JOIN x ON val_id % 5 = i")
def h09_marks(t):
    """Marks of all kinds are blanks, so names that differ in them are one."""
    given = ("A-B", "A/B Ltd.", "Acme; Pvt: Limited!", "[ACME] Inc?", 'X_Y "Z" LLP')
    return t.val.select("val_id", T.entity(F.element_at(F.array(*map(F.lit, given)), (F.col("val_id") % 5 + 1).cast("int"))).alias("entity"))


@query("h10_label", "SELECT p_partkey AS part_id, trim(regexp_replace(regexp_replace(replace(lower(p_name || ' & ' || p_type || ' (net)'), '&', ' and '), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS label FROM part")
def h10(t):
    return t.part.select(F.col("p_partkey").alias("part_id"), T.label(F.concat("p_name", F.lit(" & "), "p_type", F.lit(" (net)"))).alias("label"))


@query("h12_alias_index", "WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS alias FROM part) SELECT alias, min(p_partkey) AS part_id FROM w GROUP BY 1")
def h12(t):
    """The first that claims an alias has it."""
    return t.part.select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("alias")).groupBy("alias").agg(F.min("p_partkey").alias("part_id"))


@query("h13_percent", "SELECT l_orderkey AS inv_id, count(*) AS n, sum(CASE WHEN l_discount > 0 AND l_discount < 0.5 THEN round(l_discount * 100, 6) ELSE l_discount END::DECIMAL(18,4))::DOUBLE AS pct FROM lineitem GROUP BY 1")
def h13(t):
    pct = F.round(T.as_percent(F.col("l_discount")), 6).cast("decimal(18,4)")
    return t.lineitem.groupBy(F.col("l_orderkey").alias("inv_id")).agg(F.count("*").alias("n"), F.sum(pct).cast("double").alias("pct"))


@query("h14_percent_in_text", "SELECT val_id, try_cast(regexp_extract('rate ' || fair || '% p.a.', '([0-9]+\\.?[0-9]*)\\s*%', 1) AS DOUBLE) AS pct FROM val")
def h14(t):
    raw = F.concat(F.lit("rate "), F.col("fair").cast("string"), F.lit("% p.a."))
    return t.val.select("val_id", F.regexp_extract(raw, r"([0-9]+\.?[0-9]*)\s*%", 1).try_cast("double").alias("pct"))


@query("h16_text_to_enum", "SELECT p_partkey AS part_id, CASE WHEN contains(lower(p_type), 'econ') THEN 'equity' WHEN contains(lower(p_type), 'prom') THEN 'debt' WHEN contains(lower(p_type), 'std') OR contains(lower(p_type), 'standard') THEN 'ccps' ELSE 'other' END AS instrument FROM part")
def h16(t):
    return t.part.select(F.col("p_partkey").alias("part_id"), T.first_of(F.col("p_type"), {"econ": "equity", "prom": "debt", "std": "ccps", "standard": "ccps"}, "other").alias("instrument"))


@query("h17_level_digit_or_roman", "SELECT p_partkey AS part_id, (p_size % 3 + 1)::INT AS level FROM part")
def h17(t):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Level "), (F.col("p_size") % 3 + 1).cast("string"))).otherwise(F.concat(F.lit("level "), F.element_at(F.array(*map(F.lit, ("I", "II", "III"))), (F.col("p_size") % 3 + 1).cast("int"))))
    roman = F.regexp_extract(F.upper(raw), r"\b(I{1,3})$", 1)
    return t.part.select(F.col("p_partkey").alias("part_id"), F.coalesce(F.regexp_extract(raw, r"([1-3])", 1).try_cast("int"), F.length(roman)).alias("level"))


@query("h18_boolean_words", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE quality = 1 END AS good FROM labels")
def h18(t):
    raw = F.when(F.col("doc_id") % 3 == 0, "maybe").when(F.col("quality") == 1, " Yes").otherwise("FALSE")
    return t.labels.select("doc_id", T.truth(raw).alias("good"))


KNOWN = ("small ring", "red widget", "blue bolt", "large gear")


def likeness(a: str, b: str) -> float:
    """Twice the matched characters over all characters: the longest common stretch, the earliest of equals, and so on to its left and right."""
    matched, open_ = 0, [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        best, at, to, runs = 0, a0, b0, {}
        for i in range(a0, a1):
            now = {}
            for j in range(b0, b1):
                if a[i] == b[j]:
                    now[j] = k = runs.get(j - 1, 0) + 1
                    if k > best:
                        best, at, to = k, i - k + 1, j - k + 1
            runs = now
        if best:
            matched += best
            open_ += [(a0, at, b0, to), (at + best, a1, to + best, b1)]
    return 2 * matched / (len(a) + len(b)) if a or b else 1.0


@query("h19_fuzzy_match")
def h19(t):
    """The known label that a part's name is most like, if it is so by 0.75 or more; not an edit distance. Each distinct name is compared once."""

    @F.pandas_udf("string")
    def best(names: pd.Series) -> pd.Series:
        return names.map(lambda n: max(((likeness(n, k), k) for k in KNOWN if likeness(n, k) >= 0.75), default=(0, None))[1])

    found = t.part.select("p_name").distinct().withColumn("matched", best("p_name"))
    return t.part.select(F.col("p_partkey").alias("part_id"), "p_name").join(found, "p_name", "left").select("part_id", "matched")


@query("h20_cell_references", "SELECT n_nationkey::INT AS id, (n_nationkey + 1)::INT AS col_a, (26 + n_nationkey + 1)::INT AS col_b FROM nation")
def h20(t):
    letter = F.char(F.col("n_nationkey") + 65)
    return t.nation.select(F.col("n_nationkey").cast("int").alias("id"), T.column_index(letter).alias("col_a"), T.column_index(F.concat(F.lit("A"), letter)).alias("col_b"))


@query("h21_is_cell_reference", "SELECT inv_id, inv_id % 2 = 0 AS is_cell FROM inv")
def h21(t):
    raw = F.when(F.col("inv_id") % 2 == 0, F.concat(F.lit("Sheet!B"), (F.col("inv_id") + 1).cast("string"))).otherwise("computed: sum of calls")
    return t.inv.select("inv_id", (raw.rlike(r"^([^!]+!)?\$?[A-Z]{1,3}\$?[0-9]+$") & ~raw.rlike("computed|derived")).alias("is_cell"))


@query("h22_scale", "SELECT inv_id, (cost * CASE inv_id % 4 WHEN 0 THEN 1000 WHEN 1 THEN 100000 WHEN 2 THEN 10000000 ELSE 1 END)::DOUBLE AS scaled FROM inv")
def h22(t):
    said = F.element_at(F.array(*map(F.lit, ("in thousands", "Rs lakhs", "INR Crore", "actual"))), (F.col("inv_id") % 4 + 1).cast("int"))
    return t.inv.select("inv_id", dbl(F.col("cost") * T.unit(said).cast("decimal(12,0)")).alias("scaled"))


@query("h23_cash_cycle", "SELECT p_partkey AS part_id, (p_size + p_size % 7 - p_size % 5)::INT AS ccc FROM part")
def h23(t):
    dso, dio, dpo = F.col("p_size"), F.col("p_size") % 7, F.col("p_size") % 5
    return t.part.select(F.col("p_partkey").alias("part_id"), (dso + dio - dpo).cast("int").alias("ccc"))


@query("h24_tolerance", "SELECT r.inv_id, r.n, r.d, r.part_id, r.gross::DOUBLE AS gross, abs(r.gross::DOUBLE - p_retailprice * qty) <= 1 OR abs(r.gross::DOUBLE - p_retailprice * qty) <= 0.5 * greatest(abs(r.gross::DOUBLE), abs(p_retailprice * qty)) AS agrees FROM recv r JOIN part ON p_partkey = part_id WHERE flag = 'R'")
def h24(t):
    both = t.recv.filter("flag = 'R'").join(t.part.select(F.col("p_partkey").alias("part_id"), "p_retailprice"), "part_id")
    return both.select("inv_id", "n", "d", "part_id", dbl("gross").alias("gross"), T.close_to(dbl("gross"), F.col("p_retailprice") * F.col("qty"), 1.0, 0.5).alias("agrees"))


@query("h25_json_paths", "SELECT user_id AS holding_id, sum((props->>'$.k')::BIGINT)::BIGINT AS total, arg_max((props->>'$.k')::BIGINT, (ts, event_id)) AS latest FROM events GROUP BY 1")
def h25(t):
    k = F.from_json("props", "k long")["k"]
    return t.events.groupBy(F.col("user_id").alias("holding_id")).agg(F.sum(k).alias("total"), F.max_by(k, F.struct("ts", "event_id")).alias("latest"))


@query("h26_keyword_in_list", "SELECT conv_id, bool_or(regexp_matches(lower(text), '\\b(the|la)\\b')) AS found FROM conversations GROUP BY 1")
def h26(t):
    return t.conversations.groupBy("conv_id").agg(F.max(T.has_word(F.col("text"), "the|la")).alias("found"))


@query("h27_working_days", "SELECT inv_id, (SELECT x FROM (SELECT unnest(generate_series(d + 1, d + 15, INTERVAL 1 DAY))::DATE AS x) WHERE dayofweek(x) BETWEEN 1 AND 5 ORDER BY x LIMIT 1 OFFSET 4) AS t5, last_day(d) AS month_end, (date_trunc('quarter', d) + INTERVAL 3 MONTH + INTERVAL 14 DAY)::DATE AS due FROM inv")
def h27(t):
    return t.inv.select("inv_id", T.working_day_after(F.col("d"), 5).alias("t5"), F.last_day("d").alias("month_end"), F.date_add(F.add_months(F.trunc("d", "quarter"), 3), 14).alias("due"))


@query("h29_digests", "SELECT company_id, sha256(company) AS sha, md5(company) AS md5 FROM company")
def h29(t):
    return t.company.select("company_id", F.sha2("company", 256).alias("sha"), F.md5("company").alias("md5"))


@query("h30_display", "SELECT inv_id, strftime(d, '%d %b %Y') AS shown FROM inv")
def h30(t):
    return t.inv.select("inv_id", F.date_format("d", "dd MMM yyyy").alias("shown"))
