"""Documents and their paths (inventory A09 and H25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import COMPUTE, LATEST, SUM, resolve, uncomputed
from ..registry import query

#: A fund document of each company: its investments as commitments, calls and holdings, its receipts as distributions, its readings as valuations and net asset values.
DOCS = """oi AS (SELECT company_id, list({'commitment_amount': cost, 'stage': stage} ORDER BY inv_id) AS commitments, list({'call_date': d::VARCHAR, 'total_call_amount': CASE WHEN company_id % 3 = 0 THEN '' ELSE cost::VARCHAR END, 'called_amount': cost} ORDER BY inv_id) AS capital_calls,
  list({'total_invested': CASE status WHEN 'O' THEN cost::VARCHAR WHEN 'P' THEN 'n/a' END, 'open': status = 'O'} ORDER BY inv_id) AS portfolio_investments FROM inv GROUP BY 1),
orc AS (SELECT company_id, list({'distribution_type': CASE flag WHEN 'R' THEN 'Return_of_Capital' WHEN 'N' THEN 'LTCG' ELSE 'dividend' END, 'total_net_amount': CASE WHEN part_id % 4 <> 0 THEN net END, 'net_amount': gross} ORDER BY inv_id, n, part_id, payer_id, gross, net) AS distributions FROM recv JOIN inv USING (inv_id) GROUP BY 1),
ov AS (SELECT holding_id AS company_id, list({'valuation_date': d::VARCHAR, 'fair_value_of_holding': CASE WHEN val_id % 2 = 0 THEN fair END, 'fv_holding': holding} ORDER BY val_id) AS valuations, list({'nav_date': CASE WHEN val_id % 5 <> 0 THEN d::VARCHAR END, 'total_nav': CASE WHEN val_id % 7 = 0 THEN '' ELSE fair::VARCHAR END} ORDER BY val_id) AS nav_records FROM val GROUP BY 1),
docs AS (SELECT c.company_id, to_json({'fund_master': {'fund_name': company, 'scheme': {'name': sector, 'fund': fund}, 'vintage_year': 1990 + c.company_id % 20, 'note': ''}, 'fund_performance': {'total_distributions': cash, 'fund_nav_latest': CASE WHEN c.company_id % 4 = 0 THEN cash * 3 END, 'total_called_capital': cash * 2},
  'commitments': commitments, 'capital_calls': capital_calls, 'portfolio_investments': portfolio_investments, 'distributions': distributions, 'valuations': valuations, 'nav_records': nav_records}) AS doc FROM company c LEFT JOIN oi USING (company_id) LEFT JOIN orc USING (company_id) LEFT JOIN ov USING (company_id))"""

#: Where each figure of a fund document is found; more rows are more figures.
PATHS = (
    ("name", ["fund_master", "fund_name"]), ("sector", ["fund_master", "scheme", "name"]), ("vintage", ["fund_master", "vintage_year"]), ("note", ["fund_master", "note"]), ("scheme", ["fund_master", "scheme"]), ("beyond", ["fund_master", "fund_name", "x"]), ("missing", ["fund_master", "none", "x"]), ("into_list", ["commitments", "stage"]),
    ("calls", ["capital_calls"]), ("committed", ["commitments", SUM, "commitment_amount"]), ("called", ["capital_calls", SUM, "total_call_amount"]), ("invested", ["portfolio_investments", SUM, "total_invested"]), ("open", ["portfolio_investments", SUM, "open"]), ("sum_of_object", ["fund_master", SUM, "vintage_year"]), ("net", ["distributions", SUM, "total_net_amount"]),
    ("nav", ["nav_records", LATEST, "nav_date", "total_nav"]), ("newest", ["valuations", LATEST, "valuation_date", "valuation_date"]), ("nav_latest", ["fund_performance", "fund_nav_latest"]), ("unknown", [COMPUTE, "nothing"]),
    *[(x, [COMPUTE, x]) for x in ("sum_commitments", "sum_called", "sum_distributions", "sum_capital_distributions", "sum_active_fv", "sum_active_cost", "uncalled_capital", "drawdown_pct", "tvpi_canonical", "dpi_canonical", "rvpi_canonical", "moic_canonical", "unrealised_gain")],
)
PATHS_SQL = "paths(field, steps) AS (VALUES " + ", ".join(f"('{f}', {s!r})" for f, s in PATHS) + ")"


def fund_documents(t, file: Column | None = None) -> DataFrame:
    """company_id and doc, the JSON text of the company's fund document. With file, which tells company_ids' files, also that, and all documents of a file are in one task.

    All tables' rows are shuffled once, as plain columns; what a document calls them is added when they are in their lists, so neither names nor documents are shuffled.
    """
    c, row = F.col, F.struct
    text = lambda x: x.cast("string")
    # By one letter, in the order of the names that it stands for.
    kind = F.when(c("flag") == "R", "R").when(c("flag") == "N", "L").otherwise("d").alias("kind")
    named = lambda x: F.when(x == "R", "Return_of_Capital").when(x == "L", "LTCG").otherwise("dividend")
    own = t.company.select("company_id", row("company", "sector", "fund", "cash").alias("head"))
    recs = t.recv.join(t.inv.select("inv_id", "company_id"), "inv_id").select("company_id", row("inv_id", "n", "part_id", "payer_id", "gross", "net", kind).alias("recs"))
    for more in (t.inv.select("company_id", row("inv_id", "cost", "stage", "d", "status").alias("invs")), recs, t.val.select(c("holding_id").alias("company_id"), row("val_id", "d", "fair", "holding").alias("vals"))):
        own = own.unionByName(more.filter("company_id is not null"), allowMissingColumns=True)
    keys = ["company_id"] if file is None else ["file", "company_id"]
    gathered = (own if file is None else own.withColumn("file", file)).repartition(keys[0]).groupBy(keys).agg(*[F.collect_list(x).alias(x) for x in ("head", "invs", "recs", "vals")])
    lists = gathered.select(*keys, F.explode("head").alias("h"), *[F.when(F.size(x) > 0, F.array_sort(x)).alias(x) for x in ("invs", "recs", "vals")]).select(*keys, "h.*", "invs", "recs", "vals")
    of = lambda list_, one: F.transform(list_, one)
    all_ = lists.withColumns({
        "commitments": of("invs", lambda r: row(r["cost"].alias("commitment_amount"), r["stage"].alias("stage"))),
        "capital_calls": of("invs", lambda r: row(text(r["d"]).alias("call_date"), F.when(c("company_id") % 3 == 0, "").otherwise(text(r["cost"])).alias("total_call_amount"), r["cost"].alias("called_amount"))),
        "portfolio_investments": of("invs", lambda r: row(F.when(r["status"] == "O", text(r["cost"])).when(r["status"] == "P", "n/a").alias("total_invested"), (r["status"] == "O").alias("open"))),
        "distributions": of("recs", lambda r: row(named(r["kind"]).alias("distribution_type"), F.when(r["part_id"] % 4 != 0, r["net"]).alias("total_net_amount"), r["gross"].alias("net_amount"))),
        "valuations": of("vals", lambda r: row(text(r["d"]).alias("valuation_date"), F.when(r["val_id"] % 2 == 0, r["fair"]).alias("fair_value_of_holding"), r["holding"].alias("fv_holding"))),
        "nav_records": of("vals", lambda r: row(F.when(r["val_id"] % 5 != 0, text(r["d"])).alias("nav_date"), F.when(r["val_id"] % 7 == 0, "").otherwise(text(r["fair"])).alias("total_nav"))),
    })
    master = row(c("company").alias("fund_name"), row(c("sector").alias("name"), "fund").alias("scheme"), (c("company_id") % 20 + 1990).alias("vintage_year"), F.lit("").alias("note"))
    stated = row(c("cash").alias("total_distributions"), F.when(c("company_id") % 4 == 0, c("cash") * 3).alias("fund_nav_latest"), (c("cash") * 2).alias("total_called_capital"))
    return all_.select(*keys, F.to_json(row(master.alias("fund_master"), stated.alias("fund_performance"), "commitments", "capital_calls", "portfolio_investments", "distributions", "valuations", "nav_records")).alias("doc"))


WALK = """w AS (SELECT id, field, steps, CASE WHEN list_position(steps, '__sum__') > 0 THEN list_position(steps, '__sum__') WHEN list_position(steps, '__latest_by__') > 0 THEN list_position(steps, '__latest_by__') ELSE len(steps) + 1 END AS cut, 1 AS i, doc AS cur FROM d, paths WHERE steps[1] <> '__compute__'
  UNION ALL SELECT id, field, steps, cut, i + 1, CASE WHEN json_type(cur) = 'OBJECT' THEN json_extract(cur, '$."' || steps[i] || '"') END FROM w WHERE i < cut),
e AS (SELECT id, field, steps, cut, cur, steps[cut] AS op, CASE WHEN json_type(cur) = 'ARRAY' THEN cur->'$[*]' END AS items FROM w WHERE i = cut),
r AS (SELECT id, field, CASE op WHEN '__sum__' THEN NULL WHEN '__latest_by__' THEN (SELECT arg_max(x->>steps[cut + 2], (x->>steps[cut + 1], -k)) FROM (SELECT unnest(items) AS x, generate_subscripts(items, 1) AS k) WHERE x->>steps[cut + 1] <> '' AND x->>steps[cut + 2] <> '') ELSE CASE WHEN json_type(cur) NOT IN ('ARRAY', 'OBJECT') THEN nullif(cur->>'$', '') END END AS told,
  CASE op WHEN '__sum__' THEN (SELECT sum(try_cast(x->>steps[cut + 1] AS DECIMAL(38,6))) FROM (SELECT unnest(items) AS x) WHERE json_type(x->steps[cut + 1]) <> 'BOOLEAN') END::DOUBLE AS total, op, json_type(cur) AS shape FROM e)"""
RESOLVED = """SELECT {id} AS {name}, field, CASE WHEN coalesce(op, '') = '__sum__' THEN CASE WHEN total IS NOT NULL THEN 'number' END WHEN shape = 'ARRAY' AND coalesce(op, '') = '' THEN 'list' WHEN shape = 'OBJECT' AND coalesce(op, '') = '' THEN 'object' WHEN told IS NULL THEN NULL WHEN op IS NULL AND shape = 'BOOLEAN' THEN 'boolean' WHEN op IS NULL AND shape = 'VARCHAR' THEN 'text' WHEN try_cast(told AS DOUBLE) IS NULL THEN 'text' ELSE 'number' END AS found,
  CASE WHEN op IS NULL AND shape = 'VARCHAR' OR try_cast(told AS DOUBLE) IS NULL AND coalesce(shape, '') NOT IN ('BOOLEAN') THEN told END AS text, CASE WHEN op = '__sum__' THEN round(total, 4) WHEN op IS NULL AND shape IN ('VARCHAR', 'BOOLEAN') THEN NULL ELSE round(try_cast(told AS DOUBLE), 4) END AS number FROM r"""
FORMULAS = """b AS (SELECT company_id, (SELECT sum(try_cast(x->>'commitment_amount' AS DECIMAL(38,6))) FROM (SELECT unnest(doc->'$.commitments[*]') AS x)) AS commitments,
  (SELECT coalesce(nullif(sum(try_cast(x->>'total_call_amount' AS DECIMAL(38,6))), 0), sum(try_cast(x->>'called_amount' AS DECIMAL(38,6)))) FROM (SELECT unnest(doc->'$.capital_calls[*]') AS x)) AS called,
  (SELECT coalesce(nullif(sum(try_cast(x->>'total_net_amount' AS DECIMAL(38,6))), 0), sum(try_cast(x->>'net_amount' AS DECIMAL(38,6)))) FROM (SELECT unnest(doc->'$.distributions[*]') AS x)) AS dist,
  (SELECT sum(try_cast(coalesce(nullif(x->>'total_net_amount', ''), x->>'net_amount') AS DECIMAL(38,6))) FROM (SELECT unnest(doc->'$.distributions[*]') AS x) WHERE lower(x->>'distribution_type') IN ('return_of_capital', 'stcg', 'ltcg')) AS capital,
  (SELECT sum(try_cast(coalesce(nullif(x->>'fair_value_of_holding', ''), x->>'fv_holding') AS DECIMAL(38,6))) FROM (SELECT unnest(doc->'$.valuations[*]') AS x)) AS fv, (SELECT sum(try_cast(x->>'total_invested' AS DECIMAL(38,6))) FROM (SELECT unnest(doc->'$.portfolio_investments[*]') AS x)) AS cost,
  try_cast(doc->>'$.fund_performance.total_distributions' AS DECIMAL(38,6)) AS s_dist, try_cast(doc->>'$.fund_performance.total_called_capital' AS DECIMAL(38,6)) AS s_called,
  coalesce(nullif(try_cast(doc->>'$.fund_performance.fund_nav_latest' AS DECIMAL(38,6)), 0), (SELECT try_cast(arg_max(x->>'total_nav', (x->>'nav_date', -k)) AS DECIMAL(38,6)) FROM (SELECT unnest(doc->'$.nav_records[*]') AS x, generate_subscripts(doc->'$.nav_records[*]', 1) AS k) WHERE x->>'nav_date' <> '' AND x->>'total_nav' <> '')) AS nav FROM docs),
g AS (SELECT *, coalesce(nullif(called, 0), s_called) AS drawn, nullif(fv, 0) AS fair, nullif(cost, 0) AS spent FROM b),
x AS (SELECT company_id, unnest(['sum_commitments', 'sum_called', 'sum_distributions', 'sum_capital_distributions', 'sum_active_fv', 'sum_active_cost', 'uncalled_capital', 'drawdown_pct', 'tvpi_canonical', 'dpi_canonical', 'rvpi_canonical', 'moic_canonical', 'unrealised_gain', 'unknown']) AS field,
  unnest([commitments::DOUBLE, called::DOUBLE, dist::DOUBLE, capital::DOUBLE, fv::DOUBLE, cost::DOUBLE, (commitments - called)::DOUBLE, CASE WHEN commitments > 0 THEN called::DOUBLE / commitments::DOUBLE * 100 END, CASE WHEN drawn > 0 THEN (coalesce(nullif(dist, 0), s_dist) + nav)::DOUBLE / drawn::DOUBLE END,
    CASE WHEN drawn > 0 THEN coalesce(nullif(capital, 0), s_dist)::DOUBLE / drawn::DOUBLE END, CASE WHEN drawn > 0 THEN nav::DOUBLE / drawn::DOUBLE END, CASE WHEN spent > 0 THEN fair::DOUBLE / spent::DOUBLE END, (fair - spent)::DOUBLE, NULL]) AS v FROM g)"""


def listed(t, paths, kind: str) -> DataFrame:
    return t.spark.createDataFrame([(kind, f, s) for f, s in paths], "kind string, field string, steps array<string>")


@query("h25_paths_of_documents", f"WITH RECURSIVE {DOCS}, {PATHS_SQL}, d AS (SELECT company_id AS id, doc FROM docs), {WALK}, {FORMULAS}, f AS ({RESOLVED.format(id='id', name='company_id')} UNION ALL SELECT company_id, field, CASE WHEN v IS NOT NULL THEN 'number' END, NULL, round(v, 4) + 0 FROM x) SELECT * FROM f")
def h25_documents(t):
    """Every path's value in every company's document: fields, sums, latest items and formulas, and what isn't there."""
    docs = fund_documents(t).select(F.lit("fund").alias("kind"), "company_id", F.try_parse_json("doc").alias("doc"))
    return resolve(docs, listed(t, PATHS, "fund")).withColumn("number", F.round("number", 4))


EVENT_PATHS = (("k", ["k"]), ("inner", ["k", "x"]), ("other", ["other"]), ("sum", [SUM, "k"]))


@query("h25_paths_of_events", "WITH RECURSIVE paths(field, steps) AS (VALUES " + ", ".join(f"('{f}', {s!r})" for f, s in EVENT_PATHS) + f"), d AS (SELECT event_id AS id, props::JSON AS doc FROM events), {WALK} {RESOLVED.format(id='id', name='event_id')}")
def h25_events(t):
    docs = t.events.select(F.lit("event").alias("kind"), "event_id", F.try_parse_json("props").alias("doc"))
    return resolve(docs, listed(t, EVENT_PATHS, "event"), formulas=uncomputed).withColumn("number", F.round("number", 4))
