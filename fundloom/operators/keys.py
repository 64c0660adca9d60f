"""Natural keys as data: one plan merges the rows of all blocks (inventory J01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query

# The natural key of each block, part by part; a part is how it is normalised and the fields that may hold it, in order.
NAME, PLAIN = "name", "plain"
KEYS = {
    "investors": ((NAME, "investor_name", "legal_name"), (PLAIN, "pan")),
    "commitments": ((NAME, "investor_name", "legal_name"), (PLAIN, "scheme_name"), (PLAIN, "commitment_amount")),
    "capital_calls": ((PLAIN, "scheme_name"), (PLAIN, "call_number"), (PLAIN, "call_date"), (NAME, "investor_name")),
    "distributions": ((PLAIN, "scheme_name"), (PLAIN, "distribution_number"), (PLAIN, "distribution_date"), (NAME, "investor_name")),
    "nav_records": ((PLAIN, "scheme_name"), (PLAIN, "nav_date", "period_end")),
    "entities": ((PLAIN, "entity_type"), (NAME, "entity_name")),
    "compliance_records": ((NAME, "fund_name"), (PLAIN, "scheme_name"), (PLAIN, "compliance_type", "report_type"), (PLAIN, "due_date", "reporting_period_end")),
    "portfolio_investments": ((NAME, "company_name"), (PLAIN, "scheme_name"), (PLAIN, "instrument_type"), (PLAIN, "tranche_number"), (PLAIN, "investment_date"), (PLAIN, "amount_invested", "cost_basis", "investment_amount")),
    "valuations": ((NAME, "company_name"), (PLAIN, "valuation_date"), (PLAIN, "cost_basis", "investment_ref")),
    "exits": ((NAME, "company_name"), (PLAIN, "exit_date"), (PLAIN, "exit_type")),
    "quoted_unquoted": ((NAME, "company_name"), (PLAIN, "isin")),
    "portfolio_kpis_periodic": ((NAME, "company_name"), (PLAIN, "period")),
    "monthly_pl_rows": ((NAME, "company_name"), (PLAIN, "period")),
    "monthly_bs_rows": ((NAME, "company_name"), (PLAIN, "period")),
    "monthly_cf_rows": ((NAME, "company_name"), (PLAIN, "period")),
    "budget_vs_actual": ((NAME, "company_name"), (PLAIN, "period"), (PLAIN, "line_item")),
    "burn_runway": ((NAME, "company_name"), (PLAIN, "period")),
    "sheet_completeness": ((PLAIN, "sheet_name"), (PLAIN, "target_array")),
}
FIELDS = sorted({f for parts in KEYS.values() for _, *fields in parts for f in fields})


def part(kind: str, fields: list[str]) -> Column:
    """A part of a key: the first field that isn't empty, normalised; null for nothing."""
    raw = F.coalesce(*[F.nullif(F.col(f), F.lit("")) for f in fields])
    return F.nullif(T.entity(raw) if kind == NAME else F.lower(F.trim(raw)), F.lit(""))


def merged(rows: DataFrame, keys: dict[str, tuple] = KEYS, fields: list[str] | None = None) -> DataFrame:
    """rows(row_id, block and fields) to one row a block and natural key: block, row_id (the first row's), n_rows, key and of each field the first value, by row_id, that isn't empty.

    The keys are compiled into one expression, so all blocks are merged by one aggregate. A row without any part of its key stays by itself, and so does one of a block that has no key.
    """
    fields = fields or FIELDS
    key = F.array().cast("array<string>")
    for block, parts in keys.items():
        key = F.when(F.col("block") == block, F.array(*[part(kind, names) for kind, *names in parts])).otherwise(key)
    keyed = rows.withColumn("key", key).withColumn("alone", F.when(~F.exists("key", lambda x: x.isNotNull()), F.col("row_id")))
    first = [F.min_by(f, F.when(F.nullif(F.col(f), F.lit("")).isNotNull(), F.col("row_id"))).alias(f) for f in fields]
    return keyed.groupBy("block", "key", "alone").agg(F.min("row_id").alias("row_id"), F.count("*").alias("n_rows"), *first).drop("alone")


def value_of(j: int, field: str) -> str:
    """What a made row holds in its j-th field, as an expression of readings: often nothing, else one of a few values in several spellings."""
    if field.endswith("_name") and field not in ("scheme_name", "sheet_name"):
        filled = f"CASE (holding_id + val_id % 7 + {j}) % 4 WHEN 0 THEN 'Acme ' || ((val_id * 31 + holding_id * 7) % 6) || ' Pvt. Ltd.' WHEN 1 THEN 'ACME-' || ((val_id * 31 + holding_id * 7) % 6) WHEN 2 THEN ' acme ' || ((val_id * 31 + holding_id * 7) % 6) || ' Company' ELSE 'Limited' END"
    else:
        filled = f"CASE (holding_id + val_id % 7 + {j}) % 3 WHEN 0 THEN 'V' || ((val_id * 31 + holding_id * 7 + {j}) % 4) WHEN 1 THEN ' v' || ((val_id * 31 + holding_id * 7 + {j}) % 4) || ' ' ELSE 'v' || ((val_id * 31 + holding_id * 7 + {j}) % 4) END"
    return f"CASE WHEN (val_id * 7 + holding_id * 5 + {3 * j}) % 11 < 5 THEN NULL WHEN (val_id + holding_id + {j}) % 9 = 1 THEN '' WHEN val_id % 23 = 0 THEN NULL ELSE {filled} END"


BLOCK = f"element_at(array({', '.join(repr(b) for b in [*KEYS, 'notes'])}), cast(floor(val_id / 3) % {len(KEYS) + 1} + 1 as int))"


def made_rows(t) -> DataFrame:
    return t.val.select(F.col("val_id").alias("row_id"), F.expr(BLOCK).alias("block"), *[F.expr(value_of(j, f)).alias(f) for j, f in enumerate(FIELDS)])


def part_sql(kind: str, fields: list[str]) -> str:
    raw = "coalesce(" + ", ".join(f"nullif({f}, '')" for f in fields) + ")"
    bare = f"""trim(regexp_replace(regexp_replace(regexp_replace(lower({raw}), '[.,''()&#;:/\\\\\\-_\\[\\]{{}}"!?]', ' ', 'g'), '\\b(private|pvt|limited|ltd|llp|inc|plc|corp|company|co)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"""
    return f"nullif({bare if kind == NAME else f'lower(trim({raw}))'}, '')"


MERGED = f"""r AS (SELECT val_id AS row_id, ([{', '.join(repr(b) for b in [*KEYS, 'notes'])}])[(val_id // 3) % {len(KEYS) + 1} + 1] AS block, {', '.join(f'{value_of(j, f)} AS {f}' for j, f in enumerate(FIELDS))} FROM val),
k AS (SELECT *, CASE block {' '.join(f"WHEN '{b}' THEN [{', '.join(part_sql(kind, names) for kind, *names in parts)}]" for b, parts in KEYS.items())} ELSE []::VARCHAR[] END AS key FROM r),
m AS (SELECT block, key, min(row_id) AS row_id, count(*) AS n_rows, {', '.join(f"arg_min({f}, row_id) FILTER ({f} <> '') AS {f}" for f in FIELDS)} FROM k GROUP BY block, key, CASE WHEN len(list_filter(key, lambda x: x IS NOT NULL)) = 0 THEN row_id END)"""


@query("j01_all_natural_keys", f"WITH {MERGED} SELECT block, row_id, n_rows, coalesce(array_to_string(list_transform(key, lambda x: coalesce(x, '')), '|'), '') AS key, concat_ws('|', {', '.join(f'''coalesce({f}, '')''' for f in FIELDS)}) AS fields FROM m")
def j01(t):
    """Rows of eighteen blocks, and of one without a key, merged by their natural keys."""
    key = F.array_join(F.transform("key", lambda x: F.coalesce(x, F.lit(""))), "|")
    return merged(made_rows(t)).select("block", "row_id", "n_rows", key.alias("key"), F.concat_ws("|", *[F.coalesce(f, F.lit("")) for f in FIELDS]).alias("fields"))


@query("j01_merged_counts", f"WITH {MERGED} SELECT block, sum(n_rows)::BIGINT AS rows_in, count(*) AS rows_out, (sum(n_rows) - count(*))::BIGINT AS merged FROM m GROUP BY 1")
def j01_counts(t):
    g = merged(made_rows(t)).groupBy("block").agg(F.sum("n_rows").alias("rows_in"), F.count("*").alias("rows_out"))
    return g.withColumn("merged", F.col("rows_in") - F.col("rows_out"))
