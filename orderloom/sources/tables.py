"""Adapter from order/line-item tables to the invoice-line schema.

The tables hold none of the blemishes that cleaning must handle, so fixed key rules add them: whole
duplicate lines, zero prices, negative quantities, missing descriptions and customers, and
bookkeeping codes. Returned lines become cancellation invoices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.params import HOME_COUNTRY

GRAINS = ("name", "brand_type", "part")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def testdata_txn(spark: SparkSession, folder: str, item_grain: str = "name") -> DataFrame:
    """Line items of ``folder`` as transactions; ``item_grain`` picks what counts as an item."""
    item = {
        "name": F.col("p_name"),
        "brand_type": F.concat_ws("|", "p_brand", "p_type"),
        "part": F.concat(F.lit("P"), F.col("l_partkey").cast("string")),
    }[item_grain]
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    # country and date are attached to the orders first, so the line items meet each large table once
    headers = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "o_custkey", "o_orderdate", "n_name", "n_regionkey")
    )
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(
        headers, F.col("l_orderkey") == F.col("o_orderkey")
    )
    copies = F.when(F.col("l_orderkey") % 97 == 0, 2).otherwise(1)
    quantity = F.col("l_quantity").cast("bigint")
    return joined.select(
        F.concat(
            F.when(F.col("l_returnflag") == "R", "C").otherwise(""), F.col("l_orderkey").cast("string")
        ).alias("invoice"),
        F.when(F.col("l_partkey") % 83 == 0, "POST").otherwise(item).alias("stock_code"),
        F.when(F.col("l_partkey") % 71 != 0, F.col("p_name")).alias("description"),
        F.when(F.col("l_partkey") % 79 == 0, -quantity).otherwise(quantity).alias("quantity"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("invoice_ts"),
        F.when(F.col("l_partkey") % 89 == 0, 0.0)
        .otherwise(F.col("l_extendedprice") / F.col("l_quantity"))
        .alias("price"),
        F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("customer_id"),
        F.when(F.col("n_regionkey") == 0, HOME_COUNTRY).otherwise(F.col("n_name")).alias("country"),
        F.lit("lineitem").alias("source"),
        F.explode(F.sequence(F.lit(1), copies)).alias("_copy"),
    ).drop("_copy")


def published_revenue(spark: SparkSession, folder: str, item_grain: str = "name") -> DataFrame:
    """Revenue of the cleaned lines straight from the raw tables: one row, extended prices, no cleaning code."""
    item = {"name": "p_name", "brand_type": "concat_ws('|', p_brand, p_type)", "part": "l_partkey"}[item_grain]
    lines, parts = table(spark, folder, "lineitem"), table(spark, folder, "part")
    sold = lines.filter(
        "l_returnflag <> 'R' AND l_partkey % 83 <> 0 AND l_partkey % 89 <> 0 AND l_partkey % 79 <> 0"
    ).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    same_line = sold.select(
        "l_orderkey", F.expr(item).alias("item"), F.when(F.col("l_partkey") % 71 != 0, F.col("p_name")).alias("text"),
        "l_quantity", "l_extendedprice",
    ).distinct()
    return same_line.agg(F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).alias("revenue_gbp"))
