"""The fund-shaped views over the driver's tables; the only place that knows both vocabularies.

region > nation > customer stand for fund > sector > company, orders for investments, lineitem for receipts from them, events for
valuations and KPI readings. Money is DOUBLE there; views make it DECIMAL, so sums are exact and don't depend on the partitioning.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: All queries are as of this date where none is said otherwise.
AS_OF = "2001-12-31"
MONEY = "decimal(18,2)"

VIEWS_SQL = """company AS (SELECT c_custkey company_id, c_name company, n_name sector, r_name fund, c_mktsegment segment, c_acctbal::DECIMAL(18,2) cash
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
inv AS (SELECT o_orderkey inv_id, o_custkey company_id, o_orderdate::DATE d, o_totalprice::DECIMAL(18,2) AS cost, o_orderstatus AS status, o_orderpriority stage FROM orders),
recv AS (SELECT l_orderkey inv_id, l_partkey part_id, l_suppkey payer_id, l_linenumber n, l_shipdate::DATE d, l_extendedprice::DECIMAL(18,2) gross,
  (l_extendedprice * (1 - l_discount))::DECIMAL(18,4) net, (l_extendedprice * l_tax)::DECIMAL(18,4) tax, l_quantity qty, l_returnflag flag, l_linestatus line FROM lineitem),
val AS (SELECT event_id val_id, user_id holding_id, ts, ts::DATE d, event_type methodology, value::DECIMAL(18,2) fair, (props->>'$.k')::DECIMAL(18,2) holding FROM events)"""


class Tables:
    """Lazy tables and views of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def company(self) -> DataFrame:
        sector = self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        own = self.customer.join(sector, F.col("c_nationkey") == F.col("n_nationkey"))
        return own.select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company"), F.col("n_name").alias("sector"), F.col("r_name").alias("fund"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast(MONEY).alias("cash"))

    @cached_property
    def inv(self) -> DataFrame:
        return self.orders.select(F.col("o_orderkey").alias("inv_id"), F.col("o_custkey").alias("company_id"), F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").cast(MONEY).alias("cost"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("stage"))

    @cached_property
    def recv(self) -> DataFrame:
        return self.lineitem.select(
            F.col("l_orderkey").alias("inv_id"), F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("payer_id"), F.col("l_linenumber").alias("n"), F.to_date("l_shipdate").alias("d"), F.col("l_extendedprice").cast(MONEY).alias("gross"),
            F.expr("cast(l_extendedprice * (1 - l_discount) as decimal(18,4))").alias("net"), F.expr("cast(l_extendedprice * l_tax as decimal(18,4))").alias("tax"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line"),
        )

    @cached_property
    def val(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast(MONEY)
        return self.events.select(F.col("event_id").alias("val_id"), F.col("user_id").alias("holding_id"), "ts", F.to_date("ts").alias("d"), F.col("event_type").alias("methodology"), F.col("value").cast(MONEY).alias("fair"), k.alias("holding"))


def dbl(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def total(c, name: str) -> Column:
    """Exact sum, 0 of nothing, as a double."""
    return F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(name)


def ratio(a, b, digits: int = 4) -> Column:
    """a / b in doubles, rounded; null where b is 0 or null."""
    return F.round(F.try_divide(dbl(a), F.nullif(dbl(b), F.lit(0.0))), digits)


def rounded(x: Column, digits: int) -> Column:
    """A double rounded after it was scaled, as SQL does: F.round takes the shortest decimal form, in which a sum of weights may lie just below a half."""
    return F.round(x * 10**digits) / 10**digits


def few(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df as the broadcast side of a join if it has no more rows than that; beyond, the same join is shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
