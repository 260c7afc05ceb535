"""The typed invoice-line source (CSV or Parquet) and its Parquet cache."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.functions.expr import require

COLUMNS = (
    "invoice", "stock_code", "description", "quantity", "invoice_ts", "price", "customer_id", "country",
)
# Input headings and the column each one feeds.
HEADINGS = {
    "Invoice": "invoice",
    "StockCode": "stock_code",
    "Description": "description",
    "Quantity": "quantity",
    "InvoiceDate": "invoice_ts",
    "Price": "price",
    "Customer ID": "customer_id",
    "CustomerID": "customer_id",
    "Country": "country",
}
CSV_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in HEADINGS if name != "CustomerID"]
)


def type_cast(df: DataFrame) -> DataFrame:
    """Rename and cast to the fixed schema; an unreadable quantity fails, an unreadable date becomes NULL."""
    renamed = df.withColumnsRenamed({k: v for k, v in HEADINGS.items() if k in df.columns})
    number = F.col("quantity").try_cast("double")
    shown = F.concat(F.lit("unreadable quantity: "), F.coalesce(F.col("quantity").cast("string"), F.lit("NULL")))
    keep = [F.col("source")] if "source" in df.columns else []
    return require(renamed, number.cast("bigint").isNotNull(), shown).select(
        F.col("invoice").cast("string").alias("invoice"),
        F.col("stock_code").cast("string").alias("stock_code"),
        F.col("description").cast("string").alias("description"),
        number.cast("bigint").alias("quantity"),
        F.col("invoice_ts").try_cast("timestamp_ntz").alias("invoice_ts"),
        F.col("price").try_cast("double").alias("price"),
        F.col("customer_id").try_cast("double").cast("bigint").alias("customer_id"),
        F.col("country").cast("string").alias("country"),
        *keep,
    )


def read_transactions(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet") -> DataFrame:
    """All parts of the line source as one typed frame; ``source`` names the file of each line.

    Rows carry no order in Spark; a reader that needs date order sorts its own (small) result.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if fmt == "csv":
        raw = spark.read.schema(CSV_SCHEMA).option("header", True).csv(paths)
    elif fmt == "parquet":
        raw = spark.read.parquet(*paths)
    else:
        raise ValueError(f"unknown transaction format: {fmt}")
    return type_cast(raw.withColumn("source", F.col("_metadata.file_name")))


def cached_copy(df: DataFrame, path: str, force: bool = False) -> DataFrame:
    """The Parquet copy of the typed frame at ``path``; written if there is none yet, or anew with ``force``.

    A finished write leaves a success mark, so a copy that was cut short is not taken for one.
    """
    spark = df.sparkSession
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if force or not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
