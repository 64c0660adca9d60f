"""What is written and read back: JSON files, published snapshots, replaced parts and cascades (inventory A09, A16, A19, A20 and P09)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import ORACLES, query
from ..sources import json_files
from ..sources.snapshots import Snapshots, cascade
from ..sources.staging import shared_dir
from .documents import DOCS, fund_documents
from .fundframe import frame
from .records import a20

DOCUMENT = "company_id long, fund_master struct<fund_name: string, scheme: struct<name: string, fund: string>>, commitments array<struct<commitment_amount: decimal(18,2), stage: string>>, distributions array<struct<distribution_type: string, net_amount: decimal(18,2)>>"
#: Companies a file; of ten files the fourth is broken off.
A_FILE = 25


def folder(t, name: str) -> str:
    return f"{shared_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_documents(t, path: str) -> None:
    """Compressed files of fund documents, each a list over several lines; some are cut. Documents are made where their file is written, so they aren't shuffled."""
    c = F.col
    docs = fund_documents(t, F.floor(c("company_id") / A_FILE)).select("file", "company_id", F.concat(F.lit('{"company_id": '), c("company_id").cast("string"), F.lit(",\n"), F.substring("doc", 2, 1 << 30)).alias("doc"))
    files = docs.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("company_id", "doc"))), lambda x: x["doc"]), ",\n").alias("docs"))
    text = F.concat(F.lit("[\n"), c("docs"), F.lit("\n]\n"))
    files.select("file", F.when(c("file") % 10 == 3, F.left(text, F.length(text) - 40)).otherwise(text).alias("value")).write.partitionBy("file").text(path, compression="gzip")


def nodes(docs: DataFrame) -> DataFrame:
    """The documents' lists as rows: company_id, block, i, kind and amount."""
    c = F.col
    of = lambda block, kind, amount: docs.select("company_id", F.lit(block).alias("block"), F.posexplode(block).alias("i", "x")).select("company_id", "block", "i", c(f"x.{kind}").alias("kind"), c(f"x.{amount}").cast("double").alias("amount"))
    return of("commitments", "stage", "commitment_amount").unionByName(of("distributions", "distribution_type", "net_amount"))


@query("a09_json_files", f"""WITH {DOCS}, f AS (SELECT *, company_id // {A_FILE} AS file FROM docs)
  SELECT company_id, 'commitments' AS block, (unnest(range(len(doc->'$.commitments[*]'))))::INT AS i, unnest(doc->>'$.commitments[*].stage') AS kind, unnest(doc->'$.commitments[*].commitment_amount')::DOUBLE AS amount, NULL::BIGINT AS broken FROM f WHERE file % 10 <> 3
  UNION ALL SELECT company_id, 'distributions', (unnest(range(len(doc->'$.distributions[*]'))))::INT, unnest(doc->>'$.distributions[*].distribution_type'), unnest(doc->'$.distributions[*].net_amount')::DOUBLE, NULL FROM f WHERE file % 10 <> 3
  UNION ALL SELECT DISTINCT NULL::BIGINT, NULL, NULL::INT, NULL, NULL::DOUBLE, file FROM f WHERE file % 10 = 3""")
def a09(t):
    """Documents written to files and read back, their lists exploded; and the files that can't be read, by their number."""
    path = folder(t, "documents")
    write_documents(t, path)
    good, bad = json_files.read(t.spark, path, DOCUMENT)
    broken = bad.select(F.regexp_extract("file", "file=([0-9]+)", 1).cast("long").alias("broken"))
    return nodes(good).unionByName(broken, allowMissingColumns=True)


@query("a20_published_snapshot", f"SELECT * FROM ({ORACLES['a20_tree_snapshot']})")
def a20_published(t):
    """The tree written as a version of its own, after an older one; what is read is the newest."""
    s = Snapshots(t.spark, folder(t, "tree"))
    tree = a20(t)
    first = s.write(tree.limit(0), ["parent_id"])
    s.write(tree, ["parent_id"])
    return s.read() if s.read(first).isEmpty() else s.read(first)


@query("a16_published_metrics", f"SELECT * FROM ({ORACLES['a16_replace_scheme_metrics']})")
def a16_published(t):
    """Metrics in parts by scheme; the schemes with new ones are replaced in whole, in one version."""
    f = frame(t).select("scheme", "k", F.round(F.col("distributed") / F.col("called"), 4).alias("dpi"))
    old = f.select("scheme", F.explode(F.array(F.struct(F.lit("dpi").alias("metric"), F.lit(1.0).alias("value")), F.struct(F.lit("gone").alias("metric"), F.lit(2.0).alias("value")))).alias("x")).select("scheme", "x.*")
    s = Snapshots(t.spark, folder(t, "metrics"))
    s.write(old, ["scheme"])
    s.replace(f.filter("k % 3 = 0").select("scheme", F.lit("dpi").alias("metric"), F.col("dpi").alias("value")))
    return s.read()


@query("p09_cascade_kept_rows", """WITH gi AS (SELECT inv_id FROM inv WHERE inv_id % 7 = 3 OR company_id % 50 = 9), ki AS (SELECT * FROM inv WHERE inv_id NOT IN (SELECT inv_id FROM gi)), kr AS (SELECT * FROM recv WHERE inv_id NOT IN (SELECT inv_id FROM gi)),
  had AS (SELECT company_id FROM inv UNION ALL SELECT holding_id FROM val), has AS (SELECT company_id FROM ki UNION ALL SELECT holding_id FROM val)
  SELECT 'investments' AS kind, inv_id AS id, 0 AS n FROM ki UNION ALL SELECT 'receipts', inv_id, n FROM kr UNION ALL SELECT 'readings', val_id, 0 FROM val
  UNION ALL SELECT 'companies', company_id, 0 FROM company WHERE company_id NOT IN (SELECT company_id FROM had WHERE company_id NOT IN (SELECT company_id FROM has))
  UNION ALL SELECT 'payers', s_suppkey, 0 FROM supplier WHERE s_suppkey NOT IN (SELECT payer_id FROM recv WHERE payer_id NOT IN (SELECT payer_id FROM kr))""")
def p09_kept(t):
    """The rows that stay when an import's investments are deleted: their receipts go, and so do companies and payers that nothing else refers to."""
    tables = {"companies": t.company.select("company_id"), "payers": t.supplier.select(F.col("s_suppkey").alias("payer_id")), "investments": t.inv.select("inv_id", "company_id"), "receipts": t.recv.select("inv_id", "n", "payer_id"), "readings": t.val.select("val_id", F.col("holding_id").alias("company_id"))}
    links = [("investments", "company_id", "companies", "company_id"), ("readings", "company_id", "companies", "company_id"), ("receipts", "inv_id", "investments", "inv_id"), ("receipts", "payer_id", "payers", "payer_id")]
    stay = cascade(tables, links, {"investments": tables["investments"].filter("inv_id % 7 = 3 or company_id % 50 = 9").select("inv_id")}, ["companies", "payers"])
    told = lambda name, key, n=F.lit(0): stay[name].select(F.lit(name).alias("kind"), F.col(key).alias("id"), n.cast("int").alias("n"))
    out = told("investments", "inv_id")
    for more in (told("receipts", "inv_id", F.col("n")), told("readings", "val_id"), told("companies", "company_id"), told("payers", "payer_id")):
        out = out.unionByName(more)
    return out


@query("a19_csv_file", '''SELECT company_id || ',' || company || ',' || sector || ',' || CASE WHEN company_id % 9 = 0 THEN '"a,""b"""' WHEN company_id % 9 = 1 THEN '"line ""x"""' WHEN company_id % 9 = 2 THEN '' ELSE 'plain' END || ',' || cash::VARCHAR AS line FROM company''')
def a19_file(t):
    """A block of the dashboard as CSV files, read back as their lines: fields with a separator or a quote are quoted by the writer, quotes are doubled."""
    path, i = folder(t, "csv"), F.col("company_id") % 9
    note = F.when(i == 0, 'a,"b"').when(i == 1, 'line "x"').when(i == 2, None).otherwise("plain")
    t.company.select("company_id", "company", "sector", note.alias("note"), "cash").write.options(header="false", escape='"', emptyValue="", nullValue="").csv(path)
    return t.spark.read.text(path).select(F.col("value").alias("line"))
