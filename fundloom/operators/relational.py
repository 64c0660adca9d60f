"""Scans, filters, joins, sorting and set operations (inventory A, B, C, F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.staging import staged
from ..sources.tables import dbl, ratio, total


def positions(df: DataFrame, order: list[Column]) -> DataFrame:
    """All rows of df with pos, from 1, in the ascending order, nulls first; the order must end in a unique column.

    Rows are dealt by ranges of the order and numbered within them; each is lifted by the counts of earlier ranges, a row a range.
    """
    names = [f"_k{i}" for i in range(len(order))]
    ranged = df.withColumns(dict(zip(names, order, strict=True))).repartitionByRange(*names).sortWithinPartitions(*names).drop(*names)
    dealt = staged(ranged.withColumn("_range", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()))
    held = dealt.groupBy("_range").agg(F.count("*").alias("_held"), F.min("_seq").alias("_first"))
    before = held.select("_range", (F.sum("_held").over(Window.orderBy("_range")) - F.col("_held") - F.col("_first") + 1).alias("_before"))
    return dealt.join(before, "_range").select(*df.columns, (F.col("_seq") + F.col("_before")).cast("long").alias("pos"))


@query("a01_scan_filter", "SELECT inv_id, company_id, cost::DOUBLE AS cost FROM inv WHERE status = 'F' AND cost > 400000")
def a01(t):
    return t.inv.filter("status = 'F' and cost > 400000").select("inv_id", "company_id", dbl("cost").alias("cost"))


@query("b01_access_filter", """SELECT c.company_id, c.fund FROM company c WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.company_id AND l.quality = 1 AND l.toxic = 0)""")
def b01(t):
    """Companies with a grant (a label) that isn't revoked."""
    grants = t.labels.filter("quality = 1 and toxic = 0").select(F.col("doc_id").alias("company_id"))
    return t.company.join(grants, "company_id", "left_semi").select("company_id", "fund")


@query("b02_or_predicate", "SELECT inv_id, status, stage FROM inv WHERE status = 'P' OR stage = '1-URGENT'")
def b02(t):
    return t.inv.filter((F.col("status") == "P") | (F.col("stage") == "1-URGENT")).select("inv_id", "status", "stage")


@query("b03_in_range_cutoff", "SELECT inv_id, d FROM inv WHERE stage IN ('1-URGENT', '2-HIGH') AND cost BETWEEN 1000 AND 50000 AND d <= DATE '1998-06-30'")
def b03(t):
    return t.inv.filter(F.col("stage").isin("1-URGENT", "2-HIGH") & F.col("cost").between(1000, 50000) & (F.col("d") <= F.to_date(F.lit("1998-06-30")))).select("inv_id", "d")


@query("b04_exclude_keeps_null", "SELECT val_id, nullif(methodology, 'view') AS methodology FROM val WHERE nullif(methodology, 'view') IS DISTINCT FROM 'error'")
def b04(t):
    return t.val.select("val_id", F.nullif("methodology", F.lit("view")).alias("methodology")).filter(~F.col("methodology").eqNullSafe("error"))


@query("b05_search_two_columns", "SELECT company_id, company, segment FROM company WHERE company ILIKE '%0042%' OR segment ILIKE '%mach%'")
def b05(t):
    return t.company.filter(F.col("company").ilike("%0042%") | F.col("segment").ilike("%mach%")).select("company_id", "company", "segment")


@query("b06_optional_equalities", "SELECT company_id FROM company WHERE fund = 'ASIA' AND segment = 'BUILDING'")
def b06(t):
    asked = {"fund": "ASIA", "sector": None, "segment": "BUILDING", "company": None, "company_id": None, "cash": None}
    out = t.company
    for c, v in asked.items():
        out = out if v is None else out.filter(F.col(c) == v)
    return out.select("company_id")


@query("b07_iexact", "SELECT company_id, segment FROM company WHERE lower(segment) = lower('Machinery')")
def b07(t):
    return t.company.filter(F.lower("segment") == F.lower(F.lit("Machinery"))).select("company_id", "segment")


@query("b08_code_prefix", "SELECT stage, count(*) AS n FROM inv WHERE starts_with(stage, '1') OR starts_with(stage, '2') GROUP BY stage")
def b08(t):
    return t.inv.filter(F.col("stage").startswith("1") | F.col("stage").startswith("2")).groupBy("stage").agg(F.count("*").alias("n"))


@query("b09_month_range", "SELECT strftime(d, '%Y-%m') AS period, count(*) AS n FROM inv WHERE strftime(d, '%Y-%m') BETWEEN '1996-11' AND '1997-02' GROUP BY 1")
def b09(t):
    return t.inv.select(F.date_format("d", "yyyy-MM").alias("period")).filter(F.col("period").between("1996-11", "1997-02")).groupBy("period").agg(F.count("*").alias("n"))


@query("b10_default_scope", "SELECT company_id, company FROM company WHERE NOT (segment = 'HOUSEHOLD')")
def b10(t):
    """Sentinel rows stay hidden; one segment stands for them."""
    base = t.company.withColumn("is_aggregate", F.col("segment") == "HOUSEHOLD")
    return base.filter("not is_aggregate").select("company_id", "company")


@query("b11_display_labels", "SELECT inv_id, CASE status WHEN 'F' THEN 'Fully realised' WHEN 'O' THEN 'Active' WHEN 'P' THEN 'Partially realised' ELSE status END AS status_label FROM inv")
def b11(t):
    names = F.create_map(*[F.lit(x) for x in ("F", "Fully realised", "O", "Active", "P", "Partially realised")])
    return t.inv.select("inv_id", F.coalesce(F.try_element_at(names, F.col("status")), F.col("status")).alias("status_label"))


@query("b12_first_present_or_truthy", "SELECT val_id, coalesce(nullif(holding, 1), fair)::DOUBLE AS present, coalesce(nullif(nullif(holding, 1), 0), fair)::DOUBLE AS truthy FROM val")
def b12(t):
    """Null alone is missing in present; zero too in truthy."""
    h = F.nullif(F.col("holding"), F.lit(1).cast("decimal(18,2)"))
    return t.val.select("val_id", dbl(F.coalesce(h, F.col("fair"))).alias("present"), dbl(F.coalesce(F.nullif(h, F.lit(0).cast("decimal(18,2)")), F.col("fair"))).alias("truthy"))


@query("c01_traverse_keys", "SELECT inv_id, company, sector, fund, cost::DOUBLE AS cost FROM inv JOIN company USING (company_id)")
def c01(t):
    return t.inv.join(t.company, "company_id").select("inv_id", "company", "sector", "fund", dbl("cost").alias("cost"))


@query("c02_one_to_many", "SELECT c.company_id, count(i.inv_id) AS n, coalesce(sum(i.cost), 0)::DOUBLE AS cost FROM company c LEFT JOIN inv i USING (company_id) GROUP BY 1")
def c02(t):
    own = t.inv.groupBy("company_id").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))
    return t.company.select("company_id").join(own, "company_id", "left").select("company_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(dbl("cost"), F.lit(0.0)).alias("cost"))


LATEST_VAL = """lv AS (SELECT holding_id, val_id, d, coalesce(holding, fair) AS fv, fair FROM (SELECT *, row_number() OVER (PARTITION BY holding_id ORDER BY ts DESC, val_id DESC) rn FROM val WHERE methodology <> 'error') WHERE rn = 1)"""


def latest_valuation(t):
    """Of each holding, its newest valuation that isn't synthetic (here: an error event)."""
    kept = t.val.filter(~F.col("methodology").eqNullSafe("error"))
    row = F.max_by(F.struct("val_id", "d", F.coalesce("holding", "fair").alias("fv"), "fair"), F.struct("ts", "val_id"))
    return kept.groupBy("holding_id").agg(row.alias("r")).select("holding_id", "r.*")


@query("c03_latest_valuation", f"WITH {LATEST_VAL} SELECT holding_id, val_id, d, fv::DOUBLE AS fv FROM lv")
def c03(t):
    return latest_valuation(t).select("holding_id", "val_id", "d", dbl("fv").alias("fv"))


@query("c04_latest_with_ties", "SELECT v.holding_id, v.val_id, v.fair::DOUBLE AS fair FROM val v JOIN (SELECT holding_id, max(d) AS d FROM val GROUP BY 1) m USING (holding_id, d)")
def c04(t):
    """All valuations of the newest day: ties stay."""
    newest = t.val.groupBy("holding_id").agg(F.max("d").alias("d"))
    return t.val.join(newest, ["holding_id", "d"]).select("holding_id", "val_id", dbl("fair").alias("fair"))


@query("c05_as_of", """SELECT c.company_id, max(i.d) AS d, arg_max(i.cost, (i.d, i.inv_id))::DOUBLE AS cost FROM company c JOIN inv i ON i.company_id = c.company_id AND i.d <= DATE '1998-12-31' GROUP BY 1""")
def c05(t):
    own = t.inv.filter("d <= date'1998-12-31'").groupBy("company_id").agg(F.max_by(F.struct("d", "cost"), F.struct("d", "inv_id")).alias("r"))
    return own.join(t.company.select("company_id"), "company_id", "left_semi").select("company_id", "r.d", dbl("r.cost").alias("cost"))


@query("c05b_as_of_join", """SELECT r.inv_id, r.d, r.n, r.gross::DOUBLE AS gross, (SELECT max(v.d) FROM (SELECT DISTINCT d FROM inv WHERE stage = '1-URGENT') v WHERE v.d <= r.d) AS price_date FROM recv r WHERE r.flag = 'R'""")
def c05b(t):
    """Backward as-of join of receipts to price dates: union, then the last date so far within each month and the carried one."""
    rows = t.recv.filter("flag = 'R'")
    dates = t.inv.filter("stage = '1-URGENT'").select("d").distinct().withColumn("p", F.col("d"))
    days = rows.select("d").distinct().withColumn("p", F.lit(None).cast("date"))
    both = days.unionByName(dates).withColumn("m", F.trunc("d", "month"))
    carried = both.groupBy("m").agg(F.max("p").alias("top"))
    carried = carried.withColumn("before", F.max("top").over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)))  # one row a month
    inside = F.max("p").over(Window.partitionBy("m").orderBy("d").rangeBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("inside", inside).join(carried, "m").groupBy("d").agg(F.max(F.coalesce("inside", "before")).alias("price_date"))
    return rows.join(found, "d").select("inv_id", "d", "n", dbl("gross").alias("gross"), "price_date")


@query("c06_latest_rate_per_pair", "SELECT part_id % 10 AS pair, max(d) AS rate_date, arg_max(net, (d, inv_id, n, net))::DOUBLE AS rate FROM recv GROUP BY 1")
def c06(t):
    pair = (F.col("part_id") % 10).alias("pair")
    return t.recv.groupBy(pair).agg(F.max("d").alias("rate_date"), dbl(F.max_by("net", F.struct("d", "inv_id", "n", "net"))).alias("rate"))


@query("c07_role_playing", """SELECT n_nationkey AS id, a.r_name AS manager, b.r_name AS trustee, c.r_name AS custodian, e.r_name AS sponsor, f.r_name AS auditor FROM nation LEFT JOIN region a ON a.r_regionkey = n_regionkey
  LEFT JOIN region b ON b.r_regionkey = n_nationkey % 6 LEFT JOIN region c ON c.r_regionkey = n_nationkey % 7 LEFT JOIN region e ON e.r_regionkey = n_nationkey % 8 LEFT JOIN region f ON f.r_regionkey = n_nationkey % 9""")
def c07(t):
    out = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("manager_id"), *[(F.col("n_nationkey") % k).alias(f"{r}_id") for r, k in (("trustee", 6), ("custodian", 7), ("sponsor", 8), ("auditor", 9))])
    roles = ("manager", "trustee", "custodian", "sponsor", "auditor")
    for r in roles:
        out = out.join(t.region.select(F.col("r_regionkey").alias(f"{r}_id"), F.col("r_name").alias(r)), f"{r}_id", "left")
    return out.select("id", *roles)


@query("c08_anti_no_exit", "SELECT inv_id FROM inv WHERE NOT EXISTS (SELECT 1 FROM recv r WHERE r.inv_id = inv.inv_id)")
def c08(t):
    return t.inv.join(t.recv.select("inv_id"), "inv_id", "left_anti").select("inv_id")


@query("c09_semi_in_fund", "SELECT DISTINCT company_id FROM inv WHERE company_id IN (SELECT company_id FROM company WHERE fund = 'EUROPE')")
def c09(t):
    return t.inv.join(t.company.filter("fund = 'EUROPE'"), "company_id", "left_semi").select("company_id").distinct()


@query("c10_no_open_alert", """SELECT v.val_id FROM val v WHERE v.methodology = 'purchase' AND NOT EXISTS (SELECT 1 FROM val a WHERE a.holding_id = v.holding_id AND a.d = v.d AND a.methodology = 'error' AND a.fair > 100)""")
def c10(t):
    alerts = t.val.filter("methodology = 'error' and fair > 100").select("holding_id", "d")
    return t.val.filter("methodology = 'purchase'").join(alerts, ["holding_id", "d"], "left_anti").select("val_id")


@query("c12_longest_label", """WITH r(pattern, key) AS (VALUES ('ring', 'ring'), ('red', 'colour'), ('small ring', 'small_ring'), ('widget', 'widget'), ('red widget', 'red_widget'), ('bolt', 'bolt')),
  m AS (SELECT p_partkey, key, row_number() OVER (PARTITION BY p_partkey ORDER BY length(pattern) DESC, pattern) rn FROM part JOIN r ON contains(lower(p_name), pattern))
  SELECT p_partkey AS part_id, key AS canonical FROM part LEFT JOIN (SELECT * FROM m WHERE rn = 1) USING (p_partkey)""")
def c12(t):
    """Exact label first, else the longest known label that it contains. The rules are a fixed list, so one pass over an expression does."""
    known = {"ring": "ring", "red": "colour", "small ring": "small_ring", "widget": "widget", "red widget": "red_widget", "bolt": "bolt"}
    hit = F.lit(None).cast("string")
    for pattern in sorted(known, key=lambda p: (len(p), [-ord(c) for c in p])):
        hit = F.when(F.lower("p_name").contains(pattern), known[pattern]).otherwise(hit)
    return t.part.select(F.col("p_partkey").alias("part_id"), hit.alias("canonical"))


@query("c14_richer_row_wins", """WITH u AS (SELECT company_id, company, segment, 1 src FROM company UNION ALL SELECT company_id, company, CASE WHEN company_id % 3 = 0 THEN NULL ELSE segment END, 0 src FROM company)
  SELECT company_id, company, segment, src::INT AS src FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY (segment IS NOT NULL)::INT DESC, src) rn FROM u) WHERE rn = 1""")
def c14(t):
    full = t.company.select("company_id", "company", "segment", F.lit(1).alias("src"))
    thin = t.company.select("company_id", "company", F.when(F.col("company_id") % 3 != 0, F.col("segment")).alias("segment"), F.lit(0).alias("src"))
    filled = sum((F.col(c).isNotNull().cast("int") for c in ("company", "segment")), F.lit(0))
    return full.unionByName(thin).groupBy("company_id").agg(F.min_by(F.struct("company", "segment", "src"), F.struct(-filled, "src")).alias("r")).select("company_id", "r.*")


@query("c15_line_items_by_entity", "SELECT company_id, coalesce(sum(net), 0)::DOUBLE AS received FROM inv LEFT JOIN recv USING (inv_id) GROUP BY 1")
def c15(t):
    own = t.recv.groupBy("inv_id").agg(F.sum("net").alias("net"))  # before the join: one row an investment moves
    return t.inv.join(own, "inv_id", "left").groupBy("company_id").agg(total("net", "received"))


TREE = "tree AS (SELECT DISTINCT fund AS id, NULL AS parent FROM company UNION ALL SELECT DISTINCT fund || '::' || sector, fund FROM company UNION ALL SELECT fund || '::' || sector || '::' || company, fund || '::' || sector FROM company)"


def tree(t):
    name = lambda *c: F.concat_ws("::", *c)
    c = t.company
    tops = c.select(F.col("fund").alias("id"), F.lit(None).cast("string").alias("parent")).distinct()
    mids = c.select(name("fund", "sector").alias("id"), F.col("fund").alias("parent")).distinct()
    return tops.unionByName(mids).unionByName(c.select(name("fund", "sector", "company").alias("id"), name("fund", "sector").alias("parent")))


@query("c16_tree_children", f"WITH {TREE} SELECT p.id, count(c.id) AS children FROM tree p LEFT JOIN tree c ON c.parent = p.id GROUP BY 1")
def c16(t):
    n = tree(t).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    return tree(t).join(n, "id", "left").select("id", F.coalesce("children", F.lit(0)).alias("children"))


@query("c17_ancestors", "SELECT company_id, fund || ' > ' || fund || '::' || sector AS ancestors FROM company")
def c17(t):
    """From the root down, out of the id itself; the tree is of fixed depth."""
    parts = F.split(F.concat_ws("::", "fund", "sector", "company"), "::")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "::"))
    return t.company.select("company_id", F.array_join(up, " > ").alias("ancestors"))


@query("c18_descendants_by_prefix", f"WITH {TREE} SELECT split_part(id, '::', 1) AS fund, count(*) AS nodes FROM tree GROUP BY 1")
def c18(t):
    return tree(t).groupBy(F.substring_index("id", "::", 1).alias("fund")).agg(F.count("*").alias("nodes"))


@query("c19_payment_match", """SELECT i.inv_id, CASE WHEN p.paid >= i.cost THEN 'paid' WHEN p.paid > 0 THEN 'partial' ELSE 'open' END AS payment FROM inv i LEFT JOIN (SELECT inv_id, sum(net) AS paid FROM recv GROUP BY 1) p USING (inv_id)""")
def c19(t):
    paid = t.recv.groupBy("inv_id").agg(F.sum("net").alias("paid"))
    state = F.when(F.col("paid") >= F.col("cost"), "paid").when(F.col("paid") > 0, "partial").otherwise("open")
    return t.inv.join(paid, "inv_id", "left").select("inv_id", state.alias("payment"))


@query("c20_sector_peers", """SELECT company_id, CASE WHEN n > 1 THEN round((s - cash)::DOUBLE / (n - 1)::DOUBLE, 4) END AS peer_mean FROM (SELECT *, count(*) OVER (PARTITION BY fund, sector) n, sum(cash) OVER (PARTITION BY fund, sector) s FROM company)""")
def c20(t):
    """Peers without the company itself: group totals less its own value; no self-join."""
    g = t.company.groupBy("fund", "sector").agg(F.count("*").alias("n"), F.sum("cash").alias("s"))
    return t.company.join(g, ["fund", "sector"]).select("company_id", ratio(F.col("s") - F.col("cash"), F.col("n") - 1).alias("peer_mean"))


@query("c21_mapping_to_active", "SELECT DISTINCT part_id, inv_id FROM recv JOIN inv USING (inv_id) WHERE status = 'O'")
def c21(t):
    return t.recv.select("part_id", "inv_id").join(t.inv.filter("status = 'O'").select("inv_id"), "inv_id").select("part_id", "inv_id").distinct()


@query("c22_scalar_subquery_sum", "SELECT fund, (SELECT coalesce(sum(cost), 0) FROM inv WHERE inv.company_id IN (SELECT company_id FROM company c2 WHERE c2.fund = f.fund))::DOUBLE AS committed FROM (SELECT DISTINCT fund FROM company) f")
def c22(t):
    own = t.inv.groupBy("company_id").agg(F.sum("cost").alias("cost"))
    return t.company.join(own, "company_id", "left").groupBy("fund").agg(total("cost", "committed"))


@query("f01_nulls_first_order", "SELECT val_id, nullif(methodology, 'error') AS methodology, row_number() OVER (ORDER BY nullif(methodology, 'error') NULLS FIRST, val_id) AS pos FROM val")
@query("f01_nulls_first_positions", "SELECT val_id, nullif(methodology, 'error') AS methodology, row_number() OVER (ORDER BY nullif(methodology, 'error') NULLS FIRST, val_id) AS pos FROM val")
def f01_whole(t):
    """The whole order."""
    rows = t.val.select("val_id", F.nullif("methodology", F.lit("error")).alias("methodology"))
    return positions(rows, [F.col("methodology"), F.col("val_id")])


@query("f02_nulls_last_top20", "SELECT val_id, nullif(holding, 1)::DOUBLE AS holding FROM val ORDER BY nullif(holding, 1) NULLS LAST, val_id LIMIT 20")
def f02(t):
    return t.val.select("val_id", dbl(F.nullif("holding", F.lit(1).cast("decimal(18,2)"))).alias("holding")).orderBy(F.asc_nulls_last("holding"), "val_id").limit(20)


@query("f04_cap_with_flag", "SELECT inv_id, (SELECT count(*) FROM inv) > 2000 AS truncated FROM inv ORDER BY inv_id LIMIT 2000")
def f04(t):
    """A report of 2000 rows; one row more is fetched to see whether it was cut."""
    got = t.inv.select("inv_id").orderBy("inv_id").limit(2001)
    return got.orderBy("inv_id").limit(2000).crossJoin(got.agg((F.count("*") > 2000).alias("truncated")))  # one row


@query("f05_rag_order", """SELECT inv_id, rag, overdue, row_number() OVER (ORDER BY CASE rag WHEN 'red' THEN 0 WHEN 'amber' THEN 1 ELSE 2 END, overdue DESC, inv_id) AS pos FROM
  (SELECT inv_id, CASE WHEN cost > 400000 THEN 'red' WHEN cost > 200000 THEN 'amber' ELSE 'green' END AS rag, date_diff('day', d, DATE '2001-12-31')::INT AS overdue FROM inv)""")
@query("f05_rag_positions", """SELECT inv_id, rag, overdue, row_number() OVER (ORDER BY CASE rag WHEN 'red' THEN 0 WHEN 'amber' THEN 1 ELSE 2 END, overdue DESC, inv_id) AS pos FROM
  (SELECT inv_id, CASE WHEN cost > 400000 THEN 'red' WHEN cost > 200000 THEN 'amber' ELSE 'green' END AS rag, date_diff('day', d, DATE '2001-12-31')::INT AS overdue FROM inv)""")
def f05_whole(t):
    """The whole order."""
    rows = t.inv.select("inv_id", F.when(F.col("cost") > 400000, "red").when(F.col("cost") > 200000, "amber").otherwise("green").alias("rag"), F.datediff(F.lit("2001-12-31").cast("date"), "d").alias("overdue"))
    rank = F.when(F.col("rag") == "red", 0).when(F.col("rag") == "amber", 1).otherwise(2)
    return positions(rows, [rank, F.col("overdue").isNull(), -F.col("overdue"), F.col("inv_id")])


@query("f06_best_and_worst", "(SELECT 'best' AS side, inv_id, cost::DOUBLE AS cost FROM inv ORDER BY cost DESC, inv_id LIMIT 10) UNION ALL (SELECT 'worst', inv_id, cost::DOUBLE FROM inv ORDER BY cost, inv_id LIMIT 10)")
def f06(t):
    side = lambda name, order: t.inv.orderBy(order, "inv_id").limit(10).select(F.lit(name).alias("side"), "inv_id", dbl("cost").alias("cost"))
    return side("best", F.desc("cost")).unionByName(side("worst", F.asc("cost")))


@query("f07_union_latest_wins", """SELECT holding_id, methodology, val_id FROM (SELECT *, row_number() OVER (PARTITION BY holding_id, methodology ORDER BY ts DESC, val_id DESC) rn FROM val WHERE methodology IN ('click', 'view', 'purchase')) WHERE rn = 1""")
def f07(t):
    a, b = t.val.filter("methodology in ('click', 'view')"), t.val.filter("methodology in ('view', 'purchase')")
    return a.unionByName(b).groupBy("holding_id", "methodology").agg(F.max_by("val_id", F.struct("ts", "val_id")).alias("val_id"))


@query("f09_concat_blocks", "SELECT inv_id AS id, cost::DOUBLE AS amount, NULL::DOUBLE AS tax FROM inv WHERE status = 'P' UNION ALL SELECT inv_id, gross::DOUBLE, tax::DOUBLE FROM recv WHERE flag = 'R'")
def f09(t):
    a = t.inv.filter("status = 'P'").select(F.col("inv_id").alias("id"), dbl("cost").alias("amount"))
    return a.unionByName(t.recv.filter("flag = 'R'").select(F.col("inv_id").alias("id"), dbl("gross").alias("amount"), dbl("tax").alias("tax")), allowMissingColumns=True)


@query("f10_key_union", "SELECT company_id FROM inv UNION SELECT holding_id FROM val UNION SELECT doc_id FROM labels")
def f10(t):
    return t.inv.select("company_id").union(t.val.select("holding_id")).union(t.labels.select("doc_id")).distinct()


@query("f11_set_intersection", "SELECT holding_id, count(DISTINCT methodology) FILTER (methodology IN ('click', 'view', 'purchase')) AS n_met FROM val GROUP BY 1")
def f11(t):
    sets = t.val.groupBy("holding_id").agg(F.collect_set("methodology").alias("s"))  # a few kinds each
    return sets.select("holding_id", F.size(F.array_intersect("s", F.array(*map(F.lit, ("click", "view", "purchase"))))).cast("long").alias("n_met"))


@query("p17_own_or_organisation", "SELECT val_id FROM val WHERE holding_id = 7 OR methodology = 'signup' ORDER BY ts DESC, val_id DESC LIMIT 100")
def p17(t):
    return t.val.filter("holding_id = 7 or methodology = 'signup'").orderBy(F.desc("ts"), F.desc("val_id")).limit(100).select("val_id")
