"""Aggregations and window semantics (inventory D and E)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import dbl, ratio, total
from ..streaming.prices import judged


@query("d01_global_totals", "SELECT coalesce(sum(cost), 0)::DOUBLE AS cost, count(*) AS n FROM inv WHERE status = 'X'")
def d01(t):
    return t.inv.filter("status = 'X'").agg(total("cost", "cost"), F.count("*").alias("n"))


@query("d02_group_sums_distinct", "SELECT stage, sum(cost)::DOUBLE AS cost, count(*) AS n, count(DISTINCT company_id) AS companies FROM inv GROUP BY 1")
def d02(t):
    return t.inv.groupBy("stage").agg(total("cost", "cost"), F.count("*").alias("n"), F.count_distinct("company_id").alias("companies"))


@query("d03_filtered_sum", "SELECT flag, coalesce(sum(net) FILTER (line = 'O'), 0)::DOUBLE AS open_net, coalesce(sum(net) FILTER (line = 'F'), 0)::DOUBLE AS done_net FROM recv GROUP BY 1")
def d03(t):
    return t.recv.groupBy("flag").agg(*[total(F.when(F.col("line") == v, F.col("net")), name) for v, name in (("O", "open_net"), ("F", "done_net"))])


@query("d04_conditional_counts", "SELECT count(*) FILTER (cost > 250000) AS large, count(*) FILTER (status = 'O') AS active, count(DISTINCT company_id) AS companies FROM inv")
def d04(t):
    return t.inv.agg(F.count_if(F.col("cost") > 250000).alias("large"), F.count_if(F.col("status") == "O").alias("active"), F.count_distinct("company_id").alias("companies"))


@query("d05_zero_filled_domain", "SELECT s.stage, count(i.inv_id) FILTER (i.status = 'F') + count(i.inv_id) FILTER (i.status = 'P') AS approved FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('9-NONE')) s(stage) LEFT JOIN inv i USING (stage) GROUP BY 1")
def d05(t):
    """All stages of the domain, also those without rows; closed ones are folded into approved."""
    domain = t.spark.createDataFrame([(s,) for s in ("1-URGENT", "2-HIGH", "3-MEDIUM", "9-NONE")], "stage string")
    n = t.inv.filter("status in ('F', 'P')").groupBy("stage").agg(F.count("*").alias("approved"))
    return domain.join(n, "stage", "left").select("stage", F.coalesce("approved", F.lit(0)).alias("approved"))


@query("d08_mean_without_zero", "SELECT methodology, round(avg(nullif(holding, 0)::DOUBLE), 4) AS mean_holding FROM val GROUP BY 1")
def d08(t):
    return t.val.groupBy("methodology").agg(F.sum("holding").alias("s"), F.count_if(F.col("holding") != 0).alias("n")).select("methodology", ratio("s", "n").alias("mean_holding"))


@query("d09_weighted_mean", "SELECT stage, round(sum(CASE WHEN cost > 100000 THEN cost * (inv_id % 30) END)::DOUBLE / sum(cost)::DOUBLE, 4) AS weighted_irr FROM inv GROUP BY 1")
def d09(t):
    """Capital of rows without a rate stays in the denominator."""
    rate = F.when(F.col("cost") > 100000, F.col("inv_id") % 30)
    return t.inv.groupBy("stage").agg(F.sum(F.col("cost") * rate).alias("a"), F.sum("cost").alias("b")).select("stage", ratio("a", "b").alias("weighted_irr"))


@query("d10_sector_summary", "SELECT c.sector, count(*) AS n, round(sum(i.cost)::DOUBLE / count(i.cost)::DOUBLE, 4) AS mean_cost, round(avg(coalesce(l.quality * 40, 50)::DOUBLE), 4) AS mean_risk FROM company c LEFT JOIN inv i USING (company_id) LEFT JOIN labels l ON l.doc_id = c.company_id GROUP BY 1")
def d10(t):
    risk = t.labels.select(F.col("doc_id").alias("company_id"), (F.col("quality") * 40).alias("risk"))
    per = t.inv.groupBy("company_id").agg(F.count("*").alias("rows"), F.sum("cost").alias("s"), F.count("cost").alias("k"))
    rows = t.company.join(per, "company_id", "left").join(risk, "company_id", "left").withColumn("rows", F.coalesce("rows", F.lit(1)))
    g = rows.groupBy("sector").agg(F.sum("rows").alias("n"), F.sum("s").alias("s"), F.sum("k").alias("k"), F.sum(F.coalesce("risk", F.lit(50)) * F.col("rows")).alias("r"))
    return g.select("sector", "n", ratio("s", "k").alias("mean_cost"), ratio("r", "n").alias("mean_risk"))


@query("d11_tiers_and_majority", """SELECT company_id, count(*) FILTER (cost < 150000) AS low, count(*) FILTER (cost >= 150000 AND cost < 350000) AS medium, count(*) FILTER (cost >= 350000) AS high,
  CASE WHEN 2 * count(*) FILTER (cost >= 350000) > count(*) THEN 'high' WHEN 2 * count(*) FILTER (cost < 150000) > count(*) THEN 'low' ELSE 'medium' END AS tier FROM inv GROUP BY 1""")
def d11(t):
    tier = F.when(F.col("cost") < 150000, "low").when(F.col("cost") < 350000, "medium").otherwise("high")
    g = t.inv.withColumn("tier", tier).groupBy("company_id").pivot("tier", ["low", "medium", "high"]).count().na.fill(0)
    n = F.col("low") + F.col("medium") + F.col("high")
    return g.select("company_id", "low", "medium", "high", F.when(2 * F.col("high") > n, "high").when(2 * F.col("low") > n, "low").otherwise("medium").alias("tier"))


def spread(c):
    """n, sum and sum of squares, exactly, of a decimal column: what mean and sample deviation need."""
    return [F.count(c).alias("n"), F.sum(c).cast("double").alias("s"), F.sum(F.col(c) * F.col(c)).cast("double").alias("q")]


STD = "sqrt(greatest((sum((fair * fair)::DECIMAL(38,4))::DOUBLE - sum(fair)::DOUBLE * sum(fair)::DOUBLE / count(fair)::DOUBLE) / (count(fair) - 1)::DOUBLE, 0.0))"


@query("d12_sample_deviation", f"SELECT methodology, holding_id, round({STD}, 4) AS sd FROM val GROUP BY 1, 2 HAVING count(fair) >= 3 AND {STD} > 1e-9")
def d12(t):
    g = t.val.groupBy("methodology", "holding_id").agg(*spread("fair")).filter("n >= 3")
    sd = F.sqrt(F.greatest((F.col("q") - F.col("s") * F.col("s") / dbl("n")) / dbl(F.col("n") - 1), F.lit(0.0)))
    return g.withColumn("sd", sd).filter("sd > 1e-9").select("methodology", "holding_id", F.round("sd", 4).alias("sd"))


@query("d14_median_of_positives", "SELECT stage, median(cost::DOUBLE) AS median_cost FROM inv WHERE cost > 0 GROUP BY 1")
def d14(t):
    return t.inv.filter("cost > 0").groupBy("stage").agg(F.median(dbl("cost")).alias("median_cost"))


@query("d15_tree_rollup", """SELECT coalesce(fund, '*') AS fund, coalesce(sector, '*') AS sector, coalesce(segment, '*') AS segment, sum(cost)::DOUBLE AS cost, sum(net)::DOUBLE AS received, round(sum(net)::DOUBLE / sum(cost)::DOUBLE, 4) AS dpi FROM
  (SELECT company_id, sum(cost) AS cost, sum(r.net) AS net FROM inv LEFT JOIN (SELECT inv_id, sum(net) AS net FROM recv GROUP BY 1) r USING (inv_id) GROUP BY 1) JOIN company USING (company_id) GROUP BY ROLLUP (fund, sector, segment)""")
def d15(t):
    """Fields are summed up the tree, ratios are made from the sums and never averaged."""
    net = t.recv.groupBy("inv_id").agg(F.sum("net").alias("net"))
    by_company = t.inv.join(net, "inv_id", "left").groupBy("company_id").agg(F.sum("cost").alias("cost"), F.sum("net").alias("net"))
    g = by_company.join(t.company, "company_id").rollup("fund", "sector", "segment").agg(F.sum("cost").alias("c"), F.sum("net").alias("r"))
    return g.select(*[F.coalesce(k, F.lit("*")).alias(k) for k in ("fund", "sector", "segment")], dbl("c").alias("cost"), dbl("r").alias("received"), ratio("r", "c").alias("dpi"))


@query("d16_child_periods", "SELECT fund, strftime(d, '%Y-%m') AS period, sum(cost)::DOUBLE AS cost, count(*) AS n FROM inv JOIN company USING (company_id) GROUP BY 1, 2")
def d16(t):
    per = t.inv.groupBy("company_id", F.date_format("d", "yyyy-MM").alias("period")).agg(F.sum("cost").alias("c"), F.count("*").alias("k"))
    return per.join(t.company, "company_id").groupBy("fund", "period").agg(total("c", "cost"), F.sum("k").alias("n"))


@query("d17_child_items", "SELECT fund, stage AS item, sum(cost)::DOUBLE AS actual FROM inv JOIN company USING (company_id) GROUP BY 1, 2")
def d17(t):
    per = t.inv.groupBy("company_id", F.col("stage").alias("item")).agg(F.sum("cost").alias("c"))
    return per.join(t.company, "company_id").groupBy("fund", "item").agg(total("c", "actual"))


@query("d18_column_profile", """WITH u AS (SELECT 'status' AS col, status AS v FROM inv UNION ALL SELECT 'stage', stage FROM inv UNION ALL SELECT 'company_id', company_id::VARCHAR FROM inv), n AS (SELECT col, count(DISTINCT v) k FROM u GROUP BY 1)
  SELECT col, v, count(*) AS n FROM u JOIN n USING (col) WHERE k <= 20 GROUP BY 1, 2 UNION ALL SELECT col, 'high cardinality', k FROM n WHERE k > 20""")
def d18(t):
    """Frequencies of columns with 20 values or fewer; others are noted. Counted first by value, so no row moves twice."""
    long = t.inv.select("status", "stage", F.col("company_id").cast("string").alias("company_id")).unpivot([], ["status", "stage", "company_id"], "col", "v")
    n = long.groupBy("col", "v").agg(F.count("*").alias("n"))
    k = n.groupBy("col").agg(F.count("v").alias("k"))
    few = n.join(k.filter("k <= 20"), "col").select("col", "v", "n")
    return few.unionByName(k.filter("k > 20").select("col", F.lit("high cardinality").alias("v"), F.col("k").alias("n")))


@query("d19_period_bounds", "SELECT fund, min(d) AS first_date, max(d) AS last_date FROM inv JOIN company USING (company_id) GROUP BY 1")
def d19(t):
    by_company = t.inv.groupBy("company_id").agg(F.min("d").alias("a"), F.max("d").alias("b"))
    return by_company.join(t.company, "company_id").groupBy("fund").agg(F.min("a").alias("first_date"), F.max("b").alias("last_date"))


@query("d20_distinct", "SELECT DISTINCT company_id, status FROM inv")
def d20(t):
    return t.inv.select("company_id", "status").distinct()


@query("d21_distinct_by_clean_name", "SELECT count(DISTINCT lower(trim(CASE WHEN company_id % 2 = 0 THEN ' ' || upper(segment) ELSE segment END))) AS n FROM company")
def d21(t):
    raw = F.when(F.col("company_id") % 2 == 0, F.concat(F.lit(" "), F.upper("segment"))).otherwise(F.col("segment"))
    return t.company.agg(F.count_distinct(F.lower(F.trim(raw))).alias("n"))


@query("d22_totals_by_type", "SELECT flag AS reference_type, sum(gross)::DOUBLE AS amount FROM recv GROUP BY 1")
def d22(t):
    return t.recv.groupBy(F.col("flag").alias("reference_type")).agg(total("gross", "amount"))


@query("d23_membership_flags", "SELECT holding_id, bool_or(methodology IN ('click', 'view')) AS has_pl, bool_or(methodology = 'purchase') AS has_cf, bool_or(methodology = 'error') AS has_bva FROM val GROUP BY 1")
def d23(t):
    any_of = lambda *v: F.max(F.col("methodology").isin(*v))
    return t.val.groupBy("holding_id").agg(any_of("click", "view").alias("has_pl"), any_of("purchase").alias("has_cf"), any_of("error").alias("has_bva"))


@query("d24_quorum", """SELECT company_id, count(*) FILTER (status = 'F') AS yes, count(*) FILTER (status = 'O') AS no, CASE WHEN count(*) FILTER (status <> 'P') < 3 THEN 'no quorum' WHEN count(*) FILTER (status = 'F') > count(*) FILTER (status = 'O') THEN 'approved' ELSE 'rejected' END AS outcome FROM inv GROUP BY 1""")
def d24(t):
    g = t.inv.groupBy("company_id").agg(F.count_if(F.col("status") == "F").alias("yes"), F.count_if(F.col("status") == "O").alias("no"))
    return g.withColumn("outcome", F.when(F.col("yes") + F.col("no") < 3, "no quorum").when(F.col("yes") > F.col("no"), "approved").otherwise("rejected"))


@query("d25_concentration", "SELECT sector, sum(cost)::DOUBLE AS cost FROM inv JOIN company USING (company_id) GROUP BY 1 ORDER BY sum(cost) DESC, sector LIMIT 8")
def d25(t):
    per = t.inv.groupBy("company_id").agg(F.sum("cost").alias("c"))
    return per.join(t.company, "company_id").groupBy("sector").agg(total("c", "cost")).orderBy(F.desc("cost"), "sector").limit(8)


@query("d26_latest_nav_roll", "SELECT sum(nav)::DOUBLE AS nav, round(sum(nav)::DOUBLE / count(*)::DOUBLE, 4) AS mean_nav, count(*) AS schemes FROM (SELECT company_id, arg_max(cost, (d, inv_id)) AS nav FROM inv GROUP BY 1)")
def d26(t):
    last = t.inv.groupBy("company_id").agg(F.max_by("cost", F.struct("d", "inv_id")).alias("nav"))
    return last.agg(total("nav", "nav"), ratio(F.sum("nav"), F.count("*")).alias("mean_nav"), F.count("*").alias("schemes"))


@query("e02_latest_three", "SELECT company_id, inv_id, rn::INT AS rn FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY d DESC, inv_id DESC) rn FROM inv) WHERE rn <= 3")
def e02(t):
    rn = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("d"), F.desc("inv_id")))
    return t.inv.select("company_id", "inv_id", rn.alias("rn")).filter("rn <= 3")


MONTHLY = "mon AS (SELECT company_id, date_trunc('month', d)::DATE AS m, sum(cost) AS actual FROM inv GROUP BY 1, 2)"


def monthly(t):
    return t.inv.groupBy("company_id", F.trunc("d", "month").alias("m")).agg(F.sum("cost").alias("actual"))


@query("e03_previous_period", f"WITH {MONTHLY} SELECT company_id, m, actual::DOUBLE AS actual, round((actual - p)::DOUBLE / nullif(abs(p), 0)::DOUBLE * 100, 2) AS mom_pct FROM (SELECT *, lag(actual) OVER (PARTITION BY company_id ORDER BY m) p FROM mon)")
def e03(t):
    p = F.lag("actual").over(Window.partitionBy("company_id").orderBy("m"))
    return monthly(t).withColumn("p", p).select("company_id", "m", dbl("actual").alias("actual"), F.round(F.try_divide(dbl(F.col("actual") - F.col("p")), F.nullif(dbl(F.abs("p")), F.lit(0.0))) * 100, 2).alias("mom_pct"))


@query("e04_last_two", f"WITH {MONTHLY}, q AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY m DESC) rn, lead(actual) OVER (PARTITION BY company_id ORDER BY m DESC) old FROM mon) SELECT company_id, round((actual - old)::DOUBLE / abs(old)::DOUBLE * 100, 2) AS qoq_pct FROM q WHERE rn = 1 AND old IS NOT NULL")
def e04(t):
    w = Window.partitionBy("company_id").orderBy(F.desc("m"))
    q = monthly(t).withColumn("rn", F.row_number().over(w)).withColumn("old", F.lead("actual").over(w)).filter("rn = 1 and old is not null")
    return q.select("company_id", F.round(F.try_divide(dbl(F.col("actual") - F.col("old")), dbl(F.abs("old"))) * 100, 2).alias("qoq_pct"))


@query("e05_zscore_72", f"""WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY holding_id ORDER BY ts DESC, val_id DESC) rn FROM val) WHERE rn <= 72),
  s AS (SELECT holding_id, methodology, sum(fair)::DOUBLE / count(*)::DOUBLE AS mu, {STD} AS sd FROM r GROUP BY 1, 2 HAVING count(*) >= 3)
  SELECT val_id, round((fair::DOUBLE - mu) / sd, 3) AS z FROM r JOIN s USING (holding_id, methodology) WHERE sd > 1e-9 AND abs((fair::DOUBLE - mu) / sd) > 2""")
def e05(t):
    """The last 72 rows of a holding, all items together, then deviations within its items."""
    w = Window.partitionBy("holding_id").orderBy(F.desc("ts"), F.desc("val_id"))
    r = t.val.withColumn("rn", F.row_number().over(w)).filter("rn <= 72")
    g = r.groupBy("holding_id", "methodology").agg(*spread("fair")).filter("n >= 3")
    g = g.select("holding_id", "methodology", (F.col("s") / dbl("n")).alias("mu"), F.sqrt(F.greatest((F.col("q") - F.col("s") * F.col("s") / dbl("n")) / dbl(F.col("n") - 1), F.lit(0.0))).alias("sd"))
    z = (dbl("fair") - F.col("mu")) / F.col("sd")
    return r.join(g.filter("sd > 1e-9"), ["holding_id", "methodology"]).withColumn("zz", z).filter("abs(zz) > 2").select("val_id", F.round("zz", 3).alias("z"))


@query("e06_trend", """SELECT val_id, CASE WHEN p IS NULL THEN 'stable' WHEN fair > p + 1 THEN 'up' WHEN fair < p - 1 THEN 'down' ELSE 'stable' END AS trend FROM (SELECT *, lag(fair) OVER (PARTITION BY holding_id ORDER BY ts, val_id) p FROM val)""")
def e06(t):
    p = F.lag("fair").over(Window.partitionBy("holding_id").orderBy("ts", "val_id"))
    return t.val.withColumn("p", p).select("val_id", F.when(F.col("fair") > F.col("p") + 1, "up").when(F.col("fair") < F.col("p") - 1, "down").otherwise("stable").alias("trend"))


@query("e07_last_six_periods", f"WITH {MONTHLY} SELECT company_id, m, actual::DOUBLE AS actual FROM (SELECT *, dense_rank() OVER (PARTITION BY company_id ORDER BY m DESC) k FROM mon) WHERE k <= 6")
def e07(t):
    k = F.dense_rank().over(Window.partitionBy("company_id").orderBy(F.desc("m")))
    return monthly(t).withColumn("k", k).filter("k <= 6").select("company_id", "m", dbl("actual").alias("actual"))


@query("e08_tranche_numbers", "SELECT inv_id, 'T' || row_number() OVER (PARTITION BY company_id ORDER BY d, inv_id) AS tranche FROM inv")
def e08(t):
    n = F.row_number().over(Window.partitionBy("company_id").orderBy("d", "inv_id"))
    return t.inv.select("inv_id", F.concat(F.lit("T"), n.cast("string")).alias("tranche"))


@query("e10_year_on_year", """WITH y AS (SELECT company_id, sum(cost) FILTER (year(d) = 2000) AS now, sum(cost) FILTER (year(d) = 1999) AS prior FROM inv WHERE month(d) <= 8 GROUP BY 1) SELECT company_id, coalesce(now, 0)::DOUBLE AS ytd, coalesce(prior, 0)::DOUBLE AS prior_ytd, round((now - prior)::DOUBLE / nullif(abs(prior), 0)::DOUBLE * 100, 2) AS yoy_pct FROM y""")
def e10(t):
    of = lambda y: F.sum(F.when(F.year("d") == y, F.col("cost")))
    g = t.inv.filter(F.month("d") <= 8).groupBy("company_id").agg(of(2000).alias("a"), of(1999).alias("b"))
    pct = F.round(F.try_divide(dbl(F.col("a") - F.col("b")), F.nullif(dbl(F.abs("b")), F.lit(0.0))) * 100, 2)
    return g.select("company_id", F.coalesce(dbl("a"), F.lit(0.0)).alias("ytd"), F.coalesce(dbl("b"), F.lit(0.0)).alias("prior_ytd"), pct.alias("yoy_pct"))


@query("e11_circuit_breaker", """WITH RECURSIVE o AS (SELECT holding_id, val_id, fair, row_number() OVER (PARTITION BY holding_id ORDER BY ts, val_id) rn FROM val WHERE fair > 0),
  w AS (SELECT holding_id, val_id, rn, true AS accepted, fair AS last FROM o WHERE rn = 1
  UNION ALL SELECT o.holding_id, o.val_id, o.rn, NOT (abs(o.fair::DOUBLE - w.last::DOUBLE) / w.last::DOUBLE > 0.2), CASE WHEN abs(o.fair::DOUBLE - w.last::DOUBLE) / w.last::DOUBLE > 0.2 THEN w.last ELSE o.fair END FROM w JOIN o ON o.holding_id = w.holding_id AND o.rn = w.rn + 1)
  SELECT val_id, accepted FROM w""")
def e11(t):
    """A price over 20 % off the last accepted one is rejected, and not the next one's yardstick.

    The state is carried in batches, in order within partitions of whole holdings: a holding's rows stream by, none are gathered.
    """
    rows = t.val.filter("fair > 0").select("holding_id", "ts", "val_id", dbl("fair").alias("fair")).repartition("holding_id").sortWithinPartitions("holding_id", "ts", "val_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        holding, last = None, None
        for pdf in batches:
            of, fair = pdf["holding_id"].to_numpy(), pdf["fair"].to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1), len(of)]
            parts = []
            for a, b in pairwise(cuts):
                if b > a:
                    ok, last = judged(fair[a:b], last if of[a] == holding else None)
                    holding = of[a]
                    parts.append(ok)
            yield pd.DataFrame({"val_id": pdf["val_id"], "accepted": np.concatenate(parts) if parts else np.zeros(0, dtype=bool)})

    return rows.mapInPandas(fold, "val_id long, accepted boolean")


@query("e12_hash_chain", """WITH RECURSIVE o AS (SELECT holding_id, val_id, row_number() OVER (PARTITION BY holding_id ORDER BY val_id) rn FROM val WHERE methodology = 'signup'),
  w AS (SELECT holding_id, val_id, rn, sha256('|' || val_id) AS h FROM o WHERE rn = 1 UNION ALL SELECT o.holding_id, o.val_id, o.rn, sha256(w.h || '|' || o.val_id) FROM w JOIN o ON o.holding_id = w.holding_id AND o.rn = w.rn + 1) SELECT val_id, h AS chained FROM w""")
def e12(t):
    """Each audit row is hashed with the hash of the row before it of the same actor."""
    rows = t.val.filter("methodology = 'signup'").select("holding_id", "val_id").repartition("holding_id").sortWithinPartitions("holding_id", "val_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        holding, last = None, ""
        for pdf in batches:
            out = []
            for h, i in zip(pdf["holding_id"], pdf["val_id"], strict=True):
                last = hashlib.sha256(f"{last if h == holding else ''}|{i}".encode()).hexdigest()
                holding = h
                out.append(last)
            yield pd.DataFrame({"val_id": pdf["val_id"], "chained": out})

    return rows.mapInPandas(fold, "val_id long, chained string")
