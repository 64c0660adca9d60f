"""The comprehensive report's data pack (inventory K09): all blocks of a source by GROUPING SETS over one scan of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query
from .portfolio import SLUGS, sql_list

#: Blocks of each source, by the columns that they group by; no column: the whole.
BLOCKS = {
    "investments": {
        "overview": (), "funds": ("fund",), "sectors": ("sector",), "stages": ("stage",), "exits": ("status",), "vintages": ("year",), "fund_pl": ("month",), "budget_vs_actual": ("stage", "year"), "company_pl": ("company_id",), "balance_sheet": ("company_id", "status"), "quoted_unquoted": ("segment", "status"), "fund_sectors": ("fund", "sector"),
    },
    "receipts": {"receipts": (), "distributions": ("flag",), "cash_flow": ("year",), "ledger": ("month",), "lp_accounts": ("payer_id",), "capital_calls": ("n",), "trial_balance": ("flag", "line"), "lp_distributions": ("payer_id", "flag")},
    "readings": {"readings": (), "valuations": ("methodology",), "nav": ("month",), "kpis": ("slug",), "kpi_matrix": ("company_id", "slug"), "risk_flags": ("company_id", "methodology")},
}


def packed(rows: DataFrame, blocks: dict[str, tuple[str, ...]], values: dict[str, Column]) -> DataFrame:
    """rows by each block's columns at once: block, key, field and value."""
    columns = list(dict.fromkeys(c for by in blocks.values() for c in by))
    made = rows.groupingSets([[F.col(c) for c in by] for by in blocks.values()], *columns).agg(F.grouping_id().alias("_g"), *[v.cast("double").alias(f"_v_{k}") for k, v in values.items()])
    # A column that a block doesn't group by has its bit set.
    bits = {name: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in by) for name, by in blocks.items()}
    name, key = F.lit(None).cast("string"), F.lit("")
    for block, by in blocks.items():
        name = F.when(F.col("_g") == bits[block], block).otherwise(name)
        key = F.when(F.col("_g") == bits[block], F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in by]) if by else F.lit("")).otherwise(key)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"_v_{k}").alias("value")) for k in values]))
    return made.select(name.alias("block"), key.alias("key"), each.alias("x")).select("block", "key", "x.field", "x.value")


def packed_sql(source: str, blocks: dict[str, tuple[str, ...]], values: dict[str, str]) -> str:
    """The same, a query a block."""
    parts = []
    for block, by in blocks.items():
        key = "concat_ws('|', " + ", ".join(f"coalesce({c}::VARCHAR, '-')" for c in by) + ")" if by else "''"
        group = f" GROUP BY {', '.join(by)}" if by else ""
        for field, v in values.items():
            parts.append(f"SELECT '{block}' AS block, {key} AS key, '{field}' AS field, ({v})::DOUBLE AS value FROM {source}{group}")
    return " UNION ALL ".join(parts)


VALUES_SQL = {
    "investments": {"n": "count(*)", "cost": "sum(cost)", "held": "sum(CASE WHEN status = 'O' THEN cost ELSE 0 END)", "largest": "max(cost)", "first": "min(year)"},
    "receipts": {"n": "count(*)", "gross": "sum(gross)", "net": "sum(net)", "tax": "sum(tax)", "returned": "sum(CASE WHEN flag = 'R' THEN net ELSE 0 END)"},
    "readings": {"n": "count(*)", "total": "sum(fair)", "least": "min(fair)", "most": "max(fair)", "newest": "max(val_id)"},
}


@query("k09_report_blocks", f"""WITH s1 AS (SELECT i.*, c.fund, c.sector, c.segment, year(d) AS year, strftime(d, '%Y-%m') AS month FROM inv i JOIN company c USING (company_id)), s2 AS (SELECT *, year(d) AS year, strftime(d, '%Y-%m') AS month FROM recv),
  s3 AS (SELECT *, holding_id AS company_id, strftime(d, '%Y-%m') AS month, {sql_list(SLUGS)}[val_id % {len(SLUGS)} + 1] AS slug FROM val)
  {' UNION ALL '.join(packed_sql(s, BLOCKS[k], VALUES_SQL[k]) for s, k in (('s1', 'investments'), ('s2', 'receipts'), ('s3', 'readings')))}""")
def k09(t):
    """Twenty-six blocks of the report as one list; investments, receipts and readings are read once each."""
    c = F.col
    month = F.date_format("d", "yyyy-MM").alias("month")
    inv = t.inv.join(t.company.select("company_id", "fund", "sector", "segment"), "company_id").select("company_id", "fund", "sector", "segment", "stage", "status", "cost", F.year("d").alias("year"), month)
    recv = t.recv.select("payer_id", "n", "flag", "line", "gross", "net", "tax", F.year("d").alias("year"), month)
    slug = F.element_at(F.array(*map(F.lit, SLUGS)), (c("val_id") % len(SLUGS) + 1).cast("int"))
    val = t.val.select("val_id", c("holding_id").alias("company_id"), "methodology", "fair", month, slug.alias("slug"))
    parts = [
        packed(inv, BLOCKS["investments"], {"n": F.count("*"), "cost": F.sum("cost"), "held": F.sum(F.when(c("status") == "O", c("cost")).otherwise(0)), "largest": F.max("cost"), "first": F.min("year")}),
        packed(recv, BLOCKS["receipts"], {"n": F.count("*"), "gross": F.sum("gross"), "net": F.sum("net"), "tax": F.sum("tax"), "returned": F.sum(F.when(c("flag") == "R", c("net")).otherwise(0))}),
        packed(val, BLOCKS["readings"], {"n": F.count("*"), "total": F.sum("fair"), "least": F.min("fair"), "most": F.max("fair"), "newest": F.max("val_id")}),
    ]
    return reduce(DataFrame.unionByName, parts)
