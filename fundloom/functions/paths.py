"""Values of documents by paths that are data.

A document is a VARIANT, so no schema is declared and no text is parsed twice. A path is an array of steps. A step names a field; after
``__sum__`` stands the field whose numbers are summed over a list; after ``__latest_by__`` stand the field that dates a list's items and the one
that is taken from the latest; ``__compute__`` stands first, before a formula's name. A step that isn't there gives null, and so does one into a
list or a plain value, and an empty text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = "decimal(38,6)"
SUM, LATEST, COMPUTE = "__sum__", "__latest_by__", "__compute__"
CAPITAL = ("return_of_capital", "stcg", "ltcg")


def written(steps: Column) -> Column:
    """An array of fields as the path that Spark reads; null if a field has a quote in it."""
    return F.when(~F.exists(steps, lambda x: x.contains("'")), F.concat(F.lit("$"), F.array_join(F.transform(steps, lambda x: F.concat(F.lit("['"), x, F.lit("']"))), "")))


def items(node: Column) -> Column:
    return F.coalesce(F.try_variant_get(node, "$", "array<variant>"), F.array().cast("array<variant>"))


def shape(node: Column) -> Column:
    """LIST, OBJECT, or the kind of a plain value. The schema of a whole list or object isn't made out for that."""
    whole = F.when(F.try_variant_get(node, "$", "array<variant>").isNotNull(), "LIST").when(F.try_variant_get(node, "$", "map<string,variant>").isNotNull(), "OBJECT")
    return whole.otherwise(F.schema_of_variant(node))


def text(node: Column) -> Column:
    """A plain value as text; null for an empty one, a list and an object."""
    plain = F.try_variant_get(node, "$", "array<variant>").isNull() & F.try_variant_get(node, "$", "map<string,variant>").isNull()
    return F.nullif(F.when(plain, F.try_variant_get(node, "$", "string")), F.lit(""))


def number(node: Column, path: Column | str = "$") -> Column:
    """A number there, or a text that is one; a truth value, a list and an object are none, for as texts they aren't numbers."""
    return F.trim(F.try_variant_get(node, path, "string")).try_cast(NUMBER)


def sum_of(list_: Column, one: Callable[[Column], Column]) -> Column:
    """The sum of what is a number in a list's items; null if nothing is."""
    return F.aggregate(F.transform(list_, one), F.lit(None).cast(NUMBER), lambda a, b: F.coalesce((a + b).cast(NUMBER), a, b))


def latest(list_: Column, date: Column, value: Column) -> Column:
    """The value of the item with the greatest date, as text; of equal dates the first. Items without either don't count."""
    told = F.transform(list_, lambda x, i: F.struct(text(F.try_variant_get(x, date, "variant")).alias("d"), (-i).alias("i"), text(F.try_variant_get(x, value, "variant")).alias("v")))
    return F.array_max(F.filter(told, lambda x: x["d"].isNotNull() & x["v"].isNotNull()))["v"]


def texts(node: Column | str, path: Column | str, names: tuple[str, ...]) -> Column:
    """A list's items there as structs of texts: cut once, where an item's variant would carry all field names of the document with it."""
    return F.try_variant_get(node, path, "array<struct<" + ", ".join(f"`{x.replace('`', '``')}`: string" for x in names) + ">>")


BLOCKS = {
    "commitments": ("commitment_amount",), "capital_calls": ("total_call_amount", "called_amount"), "distributions": ("total_net_amount", "net_amount", "distribution_type"),
    "valuations": ("fair_value_of_holding", "fv_holding"), "portfolio_investments": ("total_invested",), "nav_records": ("nav_date", "total_nav"),
}
STATED = ("total_distributions", "total_called_capital", "fund_nav_latest", "total_unrealised_fv_holding", "total_invested_capital")


def computed(docs: DataFrame, doc: str) -> DataFrame:
    """docs with values, a map of the formulas' names and results. A figure of 0 counts as missing where another can take its place.

    Blocks are cut once, sums are made of them once, and formulas are made of sums: each in a projection of its own.
    """
    c = F.col
    field = lambda name: F.try_variant_get(doc, f"$.{name}", "variant")
    total = lambda block, name: sum_of(c(f"_{block}"), lambda x: F.trim(x[name]).try_cast(NUMBER))
    first = lambda x, a, b: F.coalesce(F.when(x[a] != "", x[a]), x[b]).try_cast(NUMBER)
    either = lambda a, b: F.coalesce(F.nullif(c(a), F.lit(0).cast(NUMBER)), c(b))
    ratio = lambda a, b: F.when(c(b) > 0, a.cast("double") / c(b).cast("double"))
    capital = lambda x: F.lower(x["distribution_type"]).isin(*CAPITAL)
    dated = F.filter("_nav_records", lambda x: (x["nav_date"] != "") & (x["total_nav"] != ""))
    out = docs.withColumns({f"_{b}": texts(doc, f"$.{b}", names) for b, names in BLOCKS.items()} | {f"_s_{x}": number(field(f"fund_performance.{x}")) for x in STATED})
    out = out.withColumns({
        "_committed": total("commitments", "commitment_amount"), "_called1": total("capital_calls", "total_call_amount"), "_called2": total("capital_calls", "called_amount"), "_dist1": total("distributions", "total_net_amount"), "_dist2": total("distributions", "net_amount"),
        "_capital": sum_of(F.filter("_distributions", capital), lambda x: first(x, "total_net_amount", "net_amount")), "_active": sum_of(c("_valuations"), lambda x: first(x, "fair_value_of_holding", "fv_holding")), "_cost": total("portfolio_investments", "total_invested"),
        "_nav2": F.array_max(F.transform(dated, lambda x, i: F.struct(x["nav_date"], -i, x["total_nav"].alias("v"))))["v"].try_cast(NUMBER),
    })
    out = out.withColumns({"_called": either("_called1", "_called2"), "_dist": either("_dist1", "_dist2"), "_nav": either("_s_fund_nav_latest", "_nav2"), "_fair": either("_active", "_s_total_unrealised_fv_holding"), "_spent": either("_cost", "_s_total_invested_capital")})
    out = out.withColumns({"_drawn": either("_called", "_s_total_called_capital"), "_given": either("_dist", "_s_total_distributions"), "_returned": either("_capital", "_s_total_distributions")})
    results = {
        "sum_commitments": c("_committed"), "sum_called": c("_called"), "sum_distributions": c("_dist"), "sum_capital_distributions": c("_capital"), "sum_active_fv": c("_active"), "sum_active_cost": c("_cost"), "uncalled_capital": c("_committed") - c("_called"), "drawdown_pct": ratio(c("_called"), "_committed") * 100,
        "tvpi_canonical": ratio(c("_given") + c("_nav"), "_drawn"), "dpi_canonical": ratio(c("_returned"), "_drawn"), "rvpi_canonical": ratio(c("_nav"), "_drawn"), "moic_canonical": ratio(c("_fair"), "_spent"), "unrealised_gain": c("_fair") - c("_spent"),
    }
    return out.select(*docs.columns, F.create_map(*[x for k, v in results.items() for x in (F.lit(k), v.cast("double"))]).alias("values"))


def uncomputed(docs: DataFrame, doc: str) -> DataFrame:
    """For documents that no formula is about."""
    return docs.withColumn("values", F.create_map().cast("map<string,double>"))


def told(node: Column, op: Column, value_way: Column, date_way: Column, name: Column) -> list[Column]:
    """What an operation finds at a node: its shape, its text and its number, of which a plain path's are still one."""
    is_ = lambda x: op == x
    list_ = items(node)
    found = F.when(is_(LATEST), latest(list_, date_way, value_way)).when(is_(""), text(node))
    total = F.when(is_(SUM), sum_of(list_, lambda x: number(x, value_way)).cast("double")).when(is_(COMPUTE), F.try_element_at("values", name))
    return [F.when(is_(""), shape(node)).alias("_shape"), found.alias("text"), total.alias("number")]


def resolve(docs: DataFrame, paths: DataFrame, doc: str = "doc", formulas: Callable[[DataFrame, str], DataFrame] = computed, broadcast_rows: int = 10_000, literal_paths: int = 200) -> DataFrame:
    """docs(kind, doc, ...) and paths(kind, field, steps) to the docs' other columns, field, found, text and number.

    found says what the path leads to: a text, a number, a boolean, a list, an object, or nothing (null). Formulas are computed once a document,
    whatever the number of paths that name them. Few paths become columns of one row a document: so they are parsed once a query and not once an item, and
    documents aren't repeated for each. More are joined, and broadcast up to broadcast_rows.
    """
    steps, last = F.col("steps"), lambda i: F.try_element_at("steps", F.lit(i))
    special = lambda name: F.array_position("steps", name)
    op = F.when(last(1) == COMPUTE, COMPUTE).when(special(SUM) > 0, SUM).when(special(LATEST) > 0, LATEST).otherwise("")
    cut = F.when(F.col("op").isin(SUM, LATEST), F.array_position("steps", F.col("op")) - 1).otherwise(F.size("steps")).cast("int")
    own = paths.withColumn("op", op).withColumn("way", F.when((F.col("op") != COMPUTE) & (F.size("steps") > 0), written(F.slice(steps, 1, cut))))
    own = own.select("kind", "field", "op", "way", last(-1).alias("name"), written(F.array(last(-1))).alias("value_way"), written(F.array(last(-2))).alias("date_way"))
    kept, carried = [x for x in docs.columns if x not in (doc, "kind")], ["op", "_shape", "text", "number"]
    few = own.limit(min(literal_paths, broadcast_rows) + 1).collect()
    if len(few) <= min(literal_paths, broadcast_rows):
        lit = lambda x: F.lit(x).cast("string")
        summed = lambda r: sum_of(texts(doc, r["way"], (r["name"],)), lambda x: F.trim(x[r["name"]]).try_cast(NUMBER)).cast("double")
        total = lambda r: [lit(None).alias("_shape"), lit(None).alias("text"), summed(r).alias("number")]
        other = lambda r: told(F.try_variant_get(doc, lit(r["way"]), "variant"), F.lit(r["op"]), lit(r["value_way"]), lit(r["date_way"]), lit(r["name"]))
        one = lambda r: F.struct(lit(r["field"]).alias("field"), F.lit(r["op"]).alias("op"), *(total if r["op"] == SUM and r["way"] and r["value_way"] else other)(r))
        by_kind = {}
        for r in few:
            by_kind.setdefault(r["kind"], []).append(one(r))
        found = F.coalesce(*[F.when(F.col("kind") == k, F.array(*x)) for k, x in by_kind.items() if k is not None], F.lit(None).cast("array<struct<field: string, op: string, _shape: string, text: string, number: double>>"))
        met = formulas(docs, doc).select(*kept, F.explode(found).alias("_x")).select(*kept, "_x.*")
    else:
        own = F.broadcast(own) if own.count() <= broadcast_rows else own
        met = formulas(docs, doc).join(own, "kind").withColumn("_node", F.try_variant_get(doc, F.col("way"), "variant"))
        met = met.select(*kept, "field", "op", *told(F.col("_node"), F.col("op"), F.col("value_way"), F.col("date_way"), F.col("name")))
    met = met.select(*kept, "field", *carried).withColumn("number", F.coalesce("number", F.col("text").try_cast("double")))
    kind, is_ = F.col("_shape"), F.col("op") == ""
    plain = F.when(kind == "LIST", "list").when(kind == "OBJECT", "object").when(F.col("text").isNull(), None).when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "text").otherwise("number")
    met = met.withColumn("found", F.when(is_, plain).when(F.col("number").isNotNull(), "number").when(F.col("text").isNotNull(), "text"))
    return met.select(*kept, "field", "found", F.when(F.col("found") == "text", F.col("text")).alias("text"), F.when(F.col("found") == "number", F.col("number")).alias("number"))
