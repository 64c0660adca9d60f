"""Versions of tables, JSON files, cascades, documents' paths, natural keys and row routing by hand."""

import random

import pytest
from pyspark.sql import functions as F

from fundloom.functions import paths
from fundloom.operators import documents, keys, routing, sheets, sinks
from fundloom.sources import json_files
from fundloom.sources.snapshots import Conflict, Snapshots, cascade
from fundloom.sources.tables import Tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions_replace_and_read_back(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        s.read()
    make = lambda x: spark.createDataFrame(x, "scheme string, metric string, value double")
    old = [("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0), (None, "x", 4.0), ("a/b =", "x", 5.0)]
    assert s.write(make(old), ["scheme"]) == 1
    assert s.replace(make([("a", "x", 9.0), (None, "z", 8.0)])) == 2
    assert rows(s.read()) == rows(make([("a", "x", 9.0), ("b", "x", 3.0), (None, "z", 8.0), ("a/b =", "x", 5.0)]))
    assert rows(s.read(1)) == rows(make(old))
    s.replace(make([]), make([("b", "", 0.0), ("a/b =", "", 0.0)]).select("scheme"))
    assert {r["scheme"] for r in s.read().collect()} == {"a", None} or {r["scheme"] for r in s.read().collect()} == {"a", None, "a/b ="}
    assert s.write(make([])) == 4 and s.read().count() == 0 and s.read().columns == ["scheme", "metric", "value"]
    assert s.vacuum(1) > 0 and s.versions() == [4] and s.read().count() == 0


def test_a_broken_write_leaves_the_old_version(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "t"))
    s.write(spark.range(5))
    bad = spark.range(10).select(F.when(F.col("id") > 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        s.write(bad)
    assert s.versions() == [1] and rows(s.read()) == [(i,) for i in range(5)]
    other = Snapshots(spark, str(tmp_path / "t"))
    other.write(spark.range(2))
    with pytest.raises(Conflict):  # a writer that began from version 1
        s._publish("id BIGINT", {}, [], 1)
    assert rows(s.read()) == [(0,), (1,)] and s.versions() == [1, 2]


def test_cascade_follows_keys(spark):
    make = spark.createDataFrame
    tables = {"c": make([(1,), (2,), (3,), (4,)], "c long"), "i": make([(10, 1), (11, 1), (12, 2), (13, None)], "i long, c long"), "r": make([(10, 7), (11, 7), (12, 8), (12, None)], "i long, p long"), "p": make([(7,), (8,), (9,)], "p long")}
    links = [("i", "c", "c", "c"), ("r", "i", "i", "i"), ("r", "p", "p", "p")]
    stay = cascade(tables, links, {"i": make([(12,)], "i long")}, ["c", "p"])
    assert {k: rows(v) for k, v in stay.items()} == {"c": [(1,), (3,), (4,)], "i": [(10, 1), (11, 1), (13, None)], "r": [(10, 7), (11, 7)], "p": [(7,), (9,)]}
    stay = cascade(tables, links, {"c": make([(1,)], "c long")})
    assert rows(stay["i"]) == [(12, 2), (13, None)] and rows(stay["r"]) == [(12, 8), (12, None)] and rows(stay["p"]) == [(7,), (8,), (9,)]


def test_json_files_are_read_and_broken_ones_told(spark, sf, tmp_path):
    t = Tables(spark, sf)
    sinks.write_documents(t, str(tmp_path / "in"))
    good, bad = json_files.read(spark, str(tmp_path / "in"), sinks.DOCUMENT)
    broken = {int(r["file"].split("file=")[1].split("/")[0]) for r in bad.collect()}
    n = t.company.count()
    assert broken == {f for f in range((n + sinks.A_FILE - 1) // sinks.A_FILE) if f % 10 == 3}
    known = t.company.filter(~F.floor(F.col("company_id") / sinks.A_FILE).isin(*broken) if broken else F.lit(True))
    assert rows(good.select("company_id")) == rows(known.select("company_id"))
    want = t.inv.join(known.select("company_id"), "company_id").select("company_id", F.lit("commitments").alias("block"), F.col("stage").alias("kind"), F.col("cost").cast("double").alias("amount"))
    assert rows(sinks.nodes(good).filter("block = 'commitments'").select("company_id", "block", "kind", "amount")) == rows(want)


def test_paths_by_hand(spark):
    text = """{"a": {"b": [{"x": 1.5, "d": "2020-01-01"}, {"x": "2.5", "d": null}, {"x": "", "d": "2021-01-01"}, {"x": true, "d": "2019"}, 7, {"x": "n/a", "d": "2020-01-01"}]}, "e": "", "n": 3, "t": true, "q'r": 1, "z": null}"""
    docs = spark.createDataFrame([("k", 1, text), ("k", 2, "no json"), ("k", 3, None), ("k", 4, "[1, 2]"), ("other", 5, text)], "kind string, id long, doc string").withColumn("doc", F.try_parse_json("doc"))
    steps = {"sum": ["a", "b", paths.SUM, "x"], "latest": ["a", "b", paths.LATEST, "d", "x"], "list": ["a", "b"], "object": ["a"], "empty": ["e"], "n": ["n"], "t": ["t"], "beyond": ["n", "m"], "into": ["a", "b", "x"], "none": ["a", "c", "d"], "sum_none": ["n", paths.SUM, "x"], "null": ["z"], "nothing": []}
    made = spark.createDataFrame([("k", f, s) for f, s in steps.items()], "kind string, field string, steps array<string>")
    got = {(r["id"], r["field"]): (r["found"], r["text"], r["number"]) for r in paths.resolve(docs, made, formulas=paths.uncomputed).collect()}
    assert {i for i, _ in got} == {1, 2, 3, 4} and len(got) == 4 * len(steps)
    assert all(v == (None, None, None) for (i, _), v in got.items() if i != 1)
    of = {f: got[1, f] for f in steps}
    assert of["sum"] == ("number", None, 4.0) and of["latest"] == ("number", None, 1.5) and of["list"][0] == "list" and of["object"][0] == "object" and of["n"] == ("number", None, 3.0) and of["t"][0] == "boolean"
    assert all(of[f] == (None, None, None) for f in ("empty", "beyond", "into", "none", "sum_none", "null", "nothing"))
    few = paths.resolve(docs, made, formulas=paths.uncomputed, broadcast_rows=0)
    assert {(r["id"], r["field"]): (r["found"], r["text"], r["number"]) for r in few.collect()} == got


def test_merge_by_natural_key_one_row_after_another(spark, sf):
    t = Tables(spark, sf)
    made = [r.asDict() for r in keys.made_rows(t).orderBy("row_id").collect()]
    name = {r["raw"]: r["e"] for r in spark.createDataFrame([(v,) for v in {r[f] for r in made for f in keys.FIELDS} if v], "raw string").select("raw", keys.T.entity(F.col("raw")).alias("e")).collect()}
    by_key, alone = {}, []
    for r in made:
        key = []
        for kind, *fields in keys.KEYS.get(r["block"], ()):
            raw = next((r[f] for f in fields if r[f]), None)
            key.append(((name[raw] if kind == keys.NAME else raw.strip().lower()) or None) if raw else None)
        if not any(k is not None for k in key):
            alone.append(r)
            continue
        at = by_key.setdefault((r["block"], tuple(key)), {"row_id": r["row_id"], "n": 0} | dict.fromkeys(keys.FIELDS))
        at["n"] += 1
        for f in keys.FIELDS:
            at[f] = at[f] or r[f] or None
    want = [(b, v["row_id"], v["n"], *[v[f] for f in keys.FIELDS]) for (b, _), v in by_key.items()] + [(r["block"], r["row_id"], 1, *[r[f] or None for f in keys.FIELDS]) for r in alone]
    got = keys.merged(keys.made_rows(t)).select("block", "row_id", "n_rows", *keys.FIELDS)
    assert rows(got) == sorted(want, key=str) and len(alone) > 5 and len({r["block"] for r in made}) == 19


def test_rows_go_where_their_shape_says(spark):
    schema = "row_id long, domain string, " + ", ".join([f"{f} string" for f in routing.TEXTS] + [f"{f} date" for f in routing.DATES] + [f"{f} decimal(18,4)" for f in routing.NUMBERS])
    names = [x.split()[0] for x in schema.replace("decimal(18,4)", "d").split(", ")]
    day = __import__("datetime").date(2024, 3, 31)
    some = [
        {"domain": "capital_calls", "call_number": "1", "investor_name": "A"}, {"domain": "capital_calls", "investor_name": "B"}, {"domain": "capital_calls", "investor_name": "B"}, {"domain": "capital_calls", "call_ref": ""}, {"domain": "commitments", "investor_name": "C"}, {"domain": "capital_calls", "investor_name": "C"},
        {"domain": "exits_distributions", "exit_date": day, "proceeds": "1,000.5", "source_sheet": "Exits and Payouts", "total_net_amount": 7}, {"domain": "exits_distributions", "exit_date": day, "proceeds": "x", "source_sheet": "EXITS"}, {"domain": "exits_distributions", "distribution_number": "D-07", "total_gross_amount": 5},
        {"domain": "exits_distributions", "distribution_number": "Validation: sum of 12", "total_gross_amount": 5}, {"domain": "exits_distributions", "period": "FY24", "total_net_amount": 0}, {"domain": "valuations_kpis", "fair_value": 1, "arr": 2, "company_name": "X"}, {"domain": "valuations_kpis"}, {"domain": "portfolio_investments", "company_name": " x ", "fair_value": 3, "valuation_date": day},
        {"domain": "nav_accounting", "total_nav": 4, "period": "P1"}, {"domain": "nav_accounting", "total_nav": 4, "description": "fee"}, {"domain": "nav_accounting", "line_item": "Closing Fund NAV", "period": "P1", "period_value": 9}, {"domain": "nav_calculation", "line_item": " Net NAV:", "period": "P2", "period_value": 9}, {"domain": "nav_calculation", "line_item": "Net NAV", "period": "P2", "period_value": 8},
        {"domain": "nav_calculation", "line_item": "Net NAV", "period": "P3", "period_value": 0}, {"domain": "financials_pl_bva", "budget": 1, "company_name": "X"}, {"domain": "financials_pl_bva", "company_name": "X"}, {"domain": "financials_pl_bva"}, {"domain": "unknown", "company_name": "X"},
    ]
    data = [tuple({"row_id": i, **x}.get(n) if n not in routing.NUMBERS or x.get(n) is None else __import__("decimal").Decimal(x[n]) for n in names) for i, x in enumerate(some)]
    got = {}
    for r in routing.routed(spark.createDataFrame(data, schema)).collect():
        got.setdefault(r["row_id"], {})[r["block"]] = (r["derived"], r["day"], None if r["amount"] is None else float(r["amount"]), None if r["other"] is None else float(r["other"]))
    blocks = {i: set(x) for i, x in got.items()}
    assert blocks == {0: {"capital_calls"}, 1: {"commitments"}, 4: {"commitments"}, 6: {"exits", "distributions"}, 7: {"exits"}, 8: {"distributions"}, 10: {"distributions"}, 11: {"valuations", "portfolio_kpis"}, 12: {"valuations"}, 13: {"portfolio_investments", "valuations"}, 14: {"nav_records"}, 15: {"fund_ledger"}, 16: {"fund_ledger"}, 17: {"nav_records"}, 20: {"budget_vs_actual"}, 21: {"portfolio_kpis"}}
    assert got[6]["distributions"] == (True, day, 1000.5, 7.0) and got[11]["valuations"][1] == day and got[13]["valuations"][0] and got[17]["nav_records"][2] == 9.0


def test_headers_by_hand(spark):
    grid = [("s", 0, 0, "Deal list", "text"), *[("s", 1, k, h, "text") for k, h in enumerate(("Name", "Who", "Code", "Amount (Cr)", "Quarter", "FY"))]]
    for i in range(4):
        grid += [("s", 2 + i, 0, f"PC-{i}", "text"), ("s", 2 + i, 1, f"Long Company Name {i}", "text"), ("s", 2 + i, 2, f"PC-{i}", "text"), ("s", 2 + i, 3, str(i), "number"), ("s", 2 + i, 4, f"Q{i + 1} FY24", "text"), ("s", 2 + i, 5, "FY24", "text")]
    grid += [("s", 6, 0, "Grand Total", "text"), ("s", 6, 3, "6", "number"), ("s", 7, 0, "B. next section", "text"), ("t", 0, 0, "no header", "text"), ("t", 0, 1, "x", "text")]
    cells = spark.createDataFrame(grid, "sheet string, row long, col long, raw string, kind string")
    aliases = spark.createDataFrame([("total_invested", "amount"), ("financial_year", "fy"), ("company_id", "code")], "canon string, alias string")
    guesses = spark.createDataFrame([("name", "company_name"), ("who", "company_name")], "header string, canon string")
    found = sheets.bound(cells, aliases, guesses)
    assert {(r["sheet"], r["canon"]): (r["header"], r["col"]) for r in found.collect()} == {("s", "company_name"): (1, 1), ("s", "total_invested"): (1, 3), ("s", "financial_year"): (1, 5), ("s", "company_id"): (1, 2), ("s", "period"): (1, 4)}
    assert [r["row"] for r in sheets.extracted(cells, found, ["company_name", "total_invested"]).orderBy("row").collect()] == [2, 3, 4, 5]


def test_report_reads_each_source_once(spark, sf):
    from fundloom import catalog
    from fundloom.operators import report

    df = catalog.QUERIES["k09_report_blocks"](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert {t: plan.count(k) for t, k in (("lineitem", "l_shipdate#"), ("orders", "o_orderdate#"), ("events", "event_id#"))} and plan.count("Relation [") == 6  # with company's three
    blocks = {b for x in report.BLOCKS.values() for b in x}
    assert len(blocks) >= 20 and {r["block"] for r in df.select("block").distinct().collect()} == blocks
