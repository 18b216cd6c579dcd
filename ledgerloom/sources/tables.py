"""Loading of the Parquet tables and the views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = ("revenue", "operating_profit", "net_income", "liabilities", "equity")
EVENT_REPORT = "5-LOW"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Financial facts seen in the order tables: one row per order.

    Company is the customer's nation, the metric follows from the order number, the period from the order's
    status and the report type from its priority.
    """
    orders = load(spark, sf_dir, "orders")
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    period = F.when(F.col("o_orderstatus") == "F", "annual").when(F.col("o_orderstatus") == "O", "quarterly").otherwise("semiannual")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("o_orderkey").alias("fact_id"),
        F.col("n_name").alias("company"),
        F.year("o_orderdate").alias("fiscal_year"),
        F.element_at(F.array(*map(F.lit, METRICS)), (F.col("o_orderkey") % len(METRICS)).cast("int") + 1).alias("metric"),
        F.col("o_totalprice").alias("value"),
        period.alias("period_type"),
        F.col("o_orderpriority").alias("report_type"),
    )


FACTS_SQL = """facts AS (
  SELECT o_orderkey AS fact_id, n_name AS company, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year,
         (['revenue', 'operating_profit', 'net_income', 'liabilities', 'equity'])[(o_orderkey % 5) + 1] AS metric,
         o_totalprice AS value,
         CASE o_orderstatus WHEN 'F' THEN 'annual' WHEN 'O' THEN 'quarterly' ELSE 'semiannual' END AS period_type,
         o_orderpriority AS report_type
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""
