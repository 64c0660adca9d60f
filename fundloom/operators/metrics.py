"""The persisted metric map and the shape of extractions (inventory J09 and N19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import ORACLES, query
from .fundframe import FEE, FRAME, frame, g19

#: While a scheme is still returning capital, these are zero where they aren't known.
ZERO_EARLY = ("carry_amount_gross", "gp_clawback_provision", "gp_catchup_amount", "carry_base")
HURDLE, CARRY_PCT, SPONSOR = 8.0, 20.0, 2.5
# The map, each figure of the frame's columns. What only a workbook states is there for every third scheme, and is the last rung.
METRICS = {
    "moic": "(realised + residual) / invested", "tvpi": "tvpi", "dpi": "coalesce(distributed / called, register_distributed / called)", "rvpi": "residual_after_carry / called", "net_irr": "net_irr",
    "committed_capital": "committed", "called_capital": "called", "uncalled_capital": "CASE WHEN called IS NOT NULL THEN greatest(0.0, committed - called) END", "invested_cost": "invested", "realized_proceeds": "realised", "lp_distributions": "coalesce(distributed, register_distributed)",
    "active_fair_value": "active", "total_fair_value": "CASE WHEN active IS NOT NULL OR realised IS NOT NULL THEN coalesce(active, 0.0) + coalesce(realised, 0.0) END", "fund_nav": "nav", "residual_nav": "residual_after_carry", "nav_per_unit": "CASE WHEN units IS NOT NULL THEN nav * 100 / units WHEN stated_unit > 10000 THEN stated_unit / 100000 ELSE stated_unit END",
    "unrealised_gain": "active_fv - invested", "realised_gain": "exit_net - exit_gross", "carry_amount_gross": "gross_carry", "carry_amount_net": "coalesce(net_carry, CASE WHEN k % 3 = 2 THEN invested * 0.01 END)", "gp_clawback_provision": "coalesce(gross_carry * holdback, CASE WHEN k % 3 = 2 THEN invested * 0.002 END)",
    "gp_catchup_amount": "CASE WHEN gross_carry > 0 THEN gross_carry * 0.25 END", "preferred_return_amount": "coalesce(calls * 0.4, CASE WHEN k % 3 = 2 THEN invested * 0.3 END)", "return_of_capital_amount": "CASE WHEN k % 3 = 2 THEN least(distributed, called) END", "carry_base": "carry_base",
    "lp_total_return": "CASE WHEN k % 3 = 2 THEN distributed * 0.8 WHEN k % 3 = 1 THEN distributed * 0.7 END", "gp_total_distribution": "CASE WHEN k % 3 = 2 THEN distributed * 0.2 END", "accrued_management_fees": f"CASE WHEN k % 4 <> 1 THEN invested * {FEE} END",
    "hurdle_rate": f"CASE WHEN k % 5 <> 0 THEN {HURDLE} END", "carry_pct": f"{CARRY_PCT}", "mgmt_fee_pct": f"{FEE} * 100", "sponsor_commitment_pct": f"CASE WHEN k % 2 = 0 THEN {SPONSOR} END",
}
ACTIVE = "coalesce(nullif(active_fv, 0), nullif(portfolio_fv, 0), nullif(residual, 0), stated_nav)"
EARLY = "coalesce(distributed, 0) = 0 OR coalesce(called, 0) > coalesce(distributed, 0)"


@query("n19_whole_metric_map", f"""WITH {FRAME}, q AS (SELECT scheme, net_irr, method FROM ({ORACLES['g19_net_irr_ladder']})), a AS (SELECT f7.*, q.net_irr, method, {ACTIVE} AS active, {EARLY} AS early FROM f7 JOIN q USING (scheme)),
  m AS ({' UNION ALL '.join(f"SELECT scheme, '{k}' AS metric, ({'CASE WHEN early THEN coalesce(' + x + ', 0) ELSE ' + x + ' END' if k in ZERO_EARLY else x})::DOUBLE AS value, NULL AS note FROM a" for k, x in METRICS.items())} UNION ALL SELECT scheme, 'net_irr_method', NULL, method FROM a)
  SELECT scheme, metric, round(value, 4) + 0 AS value, note FROM m""")
def n19(t):
    """Thirty-three figures of each scheme as rows, also those that aren't known; ladders take the first figure that is, and the method of the rate is a note."""
    a = frame(t).join(g19(t).select("scheme", "net_irr", "method"), "scheme").withColumns({"active": F.expr(ACTIVE), "early": F.expr(EARLY)})

    def held(k: str) -> Column:
        x = F.expr(METRICS[k])
        return F.when(F.col("early"), F.coalesce(x, F.lit(0.0))).otherwise(x) if k in ZERO_EARLY else x

    each = [F.struct(F.lit(k).alias("metric"), F.round(held(k).cast("double"), 4).alias("value"), F.lit(None).cast("string").alias("note")) for k in METRICS]
    each.append(F.struct(F.lit("net_irr_method").alias("metric"), F.lit(None).cast("double").alias("value"), F.col("method").alias("note")))
    return a.select("scheme", F.explode(F.array(*each)).alias("x")).select("scheme", "x.metric", F.col("x.value").alias("value"), "x.note")


OBJECTS, LISTS = ("fund_performance", "fund_master", "waterfall"), ("investors", "portfolio_investments")
#: What an extraction of each company looks like: most are right, some have a block of another shape, lack a field, or aren't an object at all.
EXTRACTION = """CASE WHEN company_id % 23 = 0 THEN '[{"fund_master": {}}]' WHEN company_id % 29 = 1 THEN '{"fund_master": ' ELSE '{"fund_master": ' || CASE company_id % 5 WHEN 0 THEN '{"fund_name": "F", "inception_date": "2020-01-01"}' WHEN 1 THEN '["F"]' WHEN 2 THEN '{"fund_name": "", "inception_date": null}' WHEN 3 THEN '{"fund_name": "F"}' ELSE 'null' END
  || ', "fund_performance": ' || CASE company_id % 7 WHEN 1 THEN '3' WHEN 2 THEN '{"net_irr_cashflows": [{"date": "2024-01-01", "type": "call"}, {"date": "2025-03-31", "type": "Distribution"}], "as_of_date": "2025-03-31", "fund_nav_latest": 10, "total_distributions": 0}' WHEN 3 THEN '{"net_irr_cashflows": [{"date": "2024-01-01", "type": "call"}], "as_of_date": "2025-03-31", "fund_nav_latest": 10, "total_distributions": 7}' ELSE '{"total_distributions": 5, "provenance": {"total_distributions": "Cover!C1"}}' END
  || ', "waterfall": ' || CASE company_id % 4 WHEN 0 THEN '{"step_2_preferred_return": 1}' WHEN 1 THEN '{}' WHEN 2 THEN '{"carry": 1}' ELSE '"none"' END || ', "investors": ' || CASE WHEN company_id % 6 = 5 THEN '{}' WHEN company_id % 6 = 4 THEN '{"a": 1}' ELSE '[]' END
  || ', "portfolio_investments": ' || CASE WHEN company_id % 8 = 7 THEN '"x"' WHEN company_id % 8 = 6 THEN 'null' ELSE '[{"irr_pct": 1}]' END || ', "distributions": ' || CASE WHEN company_id % 9 < 4 THEN '[]' ELSE '[{"total_net_amount": 5}]' END || '}' END"""


def shape_rules(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """docs with rule and flagged: the sites that test an extraction's shape and its required fields. Text that isn't JSON isn't an object; rules on its blocks then find nothing."""
    shape = lambda path: F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    text = lambda path: F.nullif(F.try_variant_get(doc, path, "string"), F.lit(""))
    is_object, is_list = lambda s: F.coalesce(s.startswith("OBJECT"), F.lit(False)), lambda s: F.coalesce(s.startswith("ARRAY"), F.lit(False))
    top = is_object(F.schema_of_variant(doc))
    # What a language would call false (nothing, an empty text, list or object, zero) is taken for a missing block.
    empty = lambda path: F.coalesce(shape(path).isin("VOID", "OBJECT<>") | F.coalesce(F.try_variant_get(doc, path, "string"), F.lit("")).isin("", "[]", "{}", "0", "false"), F.lit(True))
    flags = {"top_level": ~top}
    for b in OBJECTS:
        flags[f"{b}_is_object"] = top & ~empty(f"$.{b}") & ~is_object(shape(f"$.{b}"))
    for b in LISTS:
        flags[f"{b}_is_list"] = top & ~empty(f"$.{b}") & ~is_list(shape(f"$.{b}"))
    flags["fund_name"] = top & text("$.fund_master.fund_name").isNull()
    flags["inception_date"] = top & text("$.fund_master.inception_date").isNull()
    wf = "$.waterfall"
    flags["preferred_return"] = top & is_object(shape(wf)) & ~empty(wf) & F.try_variant_get(doc, f"{wf}.step_2_preferred_return", "variant").isNull() & F.try_variant_get(doc, f"{wf}.preferred_return_amount", "variant").isNull()
    flows = F.try_variant_get(doc, "$.fund_performance.net_irr_cashflows", "array<struct<date:string,type:string>>")
    last, as_of, nav = F.try_element_at(flows, F.lit(-1)), text("$.fund_performance.as_of_date"), F.try_variant_get(doc, "$.fund_performance.fund_nav_latest", "double")
    flags["terminal_flow"] = top & F.coalesce((F.size(flows) > 0) & as_of.isNotNull() & (nav > 0) & ((F.lower(F.coalesce(last["type"], F.lit(""))) != "distribution") | (F.coalesce(last["date"], F.lit("")) != as_of)), F.lit(False))
    given = F.try_variant_get(doc, "$.fund_performance.total_distributions", "double")
    flags["distributions_of_no_rows"] = top & F.coalesce((given > 0.5) & (F.size(F.try_variant_get(doc, "$.distributions", "array<variant>")) == 0), F.lit(False))
    flags["provenance_of_distributions"] = top & F.coalesce((given > 0) & text("$.fund_performance.provenance.total_distributions").isNull(), F.lit(False))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(v, F.lit(True)).alias("flagged")) for k, v in flags.items()]))
    return docs.withColumn("x", each).select(*[c for c in docs.columns if c != doc], "x.rule", "x.flagged")


def shape_sql() -> str:
    empty = lambda b: f"coalesce(doc->>'$.{b}', '') IN ('', '[]', '{{}}', '0', 'false')"
    top = "coalesce(json_type(doc), '') = 'OBJECT'"
    flags = {"top_level": f"NOT ({top})"}
    for b in OBJECTS:
        flags[f"{b}_is_object"] = f"{top} AND NOT {empty(b)} AND json_type(doc, '$.{b}') <> 'OBJECT'"
    for b in LISTS:
        flags[f"{b}_is_list"] = f"{top} AND NOT {empty(b)} AND json_type(doc, '$.{b}') <> 'ARRAY'"
    flags["fund_name"] = f"{top} AND coalesce(doc->>'$.fund_master.fund_name', '') = ''"
    flags["inception_date"] = f"{top} AND coalesce(doc->>'$.fund_master.inception_date', '') = ''"
    flags["preferred_return"] = f"{top} AND json_type(doc, '$.waterfall') = 'OBJECT' AND NOT {empty('waterfall')} AND NOT json_exists(doc, '$.waterfall.step_2_preferred_return') AND NOT json_exists(doc, '$.waterfall.preferred_return_amount')"
    fp = "$.fund_performance"
    flags["terminal_flow"] = f"{top} AND coalesce(json_array_length(doc, '{fp}.net_irr_cashflows') > 0 AND (doc->>'{fp}.fund_nav_latest')::DOUBLE > 0 AND (lower(doc->>'{fp}.net_irr_cashflows[#-1].type') <> 'distribution' OR (doc->>'{fp}.net_irr_cashflows[#-1].date') <> (doc->>'{fp}.as_of_date')), false)"
    flags["distributions_of_no_rows"] = f"{top} AND coalesce((doc->>'{fp}.total_distributions')::DOUBLE > 0.5 AND json_array_length(doc, '$.distributions') = 0, false)"
    flags["provenance_of_distributions"] = f"{top} AND coalesce((doc->>'{fp}.total_distributions')::DOUBLE > 0 AND (doc->>'{fp}.provenance.total_distributions') IS NULL, false)"
    return " UNION ALL ".join(f"SELECT company_id, '{k}' AS rule, coalesce({v}, false) AS flagged FROM d" for k, v in flags.items())


@query("j09_shape_rules", f"WITH d AS (SELECT company_id, CASE WHEN json_valid(t) THEN t::JSON END AS doc FROM (SELECT company_id, {EXTRACTION} AS t FROM company)) {shape_sql()}")
def j09_shape(t):
    """One row an extraction and rule on its shape: a block of another kind than it must be, and fields that must be there."""
    return shape_rules(t.company.select("company_id", F.try_parse_json(F.expr(EXTRACTION)).alias("doc")))
