"""What the findings of round 4 are about, for the fund queries."""

from pyspark.sql import functions as F

from fundloom.functions import paths
from fundloom.operators import sinks
from fundloom.operators.documents import PATHS, listed
from fundloom.sources.tables import Tables

ODD = [
    '{"commitments": [{"commitment_amount": 5}, 7, null, [1], {"commitment_amount": true}, {"commitment_amount": "x"}, {"commitment_amount": " 2.5 "}, {"commitment_amount": {"a": 1}}], "capital_calls": {"a": 1}, "nav_records": [{"nav_date": "2020", "total_nav": "3"}, {"nav_date": "2021", "total_nav": ""}, {"nav_date": "2020", "total_nav": 4}]}',
    '{"distributions": [{"total_net_amount": "", "net_amount": 2, "distribution_type": "STCG"}, {"total_net_amount": 1.25, "net_amount": 9, "distribution_type": "ltcg"}, {"net_amount": 7, "distribution_type": ["ltcg"]}], "fund_master": {"fund_name": "a", "scheme": {}}, "commitments": []}',
    "[1]", "no json", None,
]


def test_few_paths_repeat_no_document(spark, sf):
    """Documents were joined with the paths, so each was carried and its lists cut once a path; paths in columns were parsed once an item."""
    docs = spark.createDataFrame([("fund", i, x) for i, x in enumerate(ODD)], "kind string, company_id long, doc string").withColumn("doc", F.try_parse_json("doc"))
    made = paths.resolve(docs, listed(Tables(spark, sf), PATHS, "fund"))
    got = {(r["company_id"], r["field"]): (r["found"], r["text"], r["number"]) for r in made.collect()}
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    joined = paths.resolve(docs, listed(Tables(spark, sf), PATHS, "fund"), literal_paths=0).collect()
    assert got == {(r["company_id"], r["field"]): (r["found"], r["text"], r["number"]) for r in joined} and len(got) == len(PATHS) * len(ODD)
    assert got[0, "committed"] == got[0, "sum_commitments"] == ("number", None, 7.5) and got[0, "nav"] == ("number", None, 3.0) and got[0, "calls"][0] == "object"
    assert got[1, "sum_distributions"] == ("number", None, 1.25) and got[1, "sum_capital_distributions"] == ("number", None, 3.25) and got[1, "committed"] == (None, None, None)


def test_files_of_documents_are_small(spark, sf, tmp_path):
    """The files held the documents' text as it is; they are compressed."""
    sinks.write_documents(Tables(spark, sf), str(tmp_path / "in"))
    files = [f for f in (tmp_path / "in").rglob("part-*") if not f.name.endswith(".crc")]
    written = sum(f.stat().st_size for f in files)
    held = spark.read.text(str(tmp_path / "in"), recursiveFileLookup=True).agg(F.sum(F.length("value"))).first()[0]
    assert 5 * written < held
