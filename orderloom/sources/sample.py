"""A reproducible stratified sample of invoice lines for fixtures."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.expr import is_cancelled, is_non_product
from orderloom.sources.transactions import COLUMNS

_SALTS = 32
_BLOCK = 65_536


class SampleSizes(NamedTuple):
    seed: int = 42
    focus_items: int = 10
    focus_rows: int = 300
    random_rows: int = 1200
    cancellations: int = 120
    non_product: int = 80
    zero_price: int = 50
    duplicate_groups: int = 15


def row_key(seed: int, stratum: str) -> Column:
    """A draw per line and stratum; only identical lines share it, so ties never matter."""
    parts = [
        F.lit(f"{seed}:{stratum}"), F.col("invoice"), F.col("stock_code"), F.coalesce("description", F.lit("")),
        F.col("quantity").cast("string"), F.date_format("invoice_ts", "yyyy-MM-dd HH:mm:ss"),
        F.coalesce(F.round(F.col("price") * 10000).cast("bigint").cast("string"), F.lit("")),
        F.coalesce(F.col("customer_id").cast("string"), F.lit("")), F.coalesce("country", F.lit("")),
    ]
    return F.md5(F.concat_ws("|", *parts))


def _up_to(distinct: DataFrame, n: int) -> DataFrame:
    """Each line as often as it occurs, but at most ``n`` times: a draw of ``n`` lines cannot use more."""
    times = F.least(F.col("copies"), F.lit(n))
    return distinct.withColumn("_c", F.explode(F.sequence(F.lit(1), times.cast("int")))).drop("_c", "copies")


def _whole(groups: DataFrame) -> DataFrame:
    """Every copy of the given lines; a large group is cut into blocks that spread over the tasks."""
    blocks = groups.withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / _BLOCK))))
    left = F.least(F.col("copies") - F.col("_b") * _BLOCK, F.lit(_BLOCK))
    spread = blocks.withColumn("_n", left.cast("int")).repartition("invoice", "_b")
    return spread.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*COLUMNS)


def _some(distinct: DataFrame, stratum: str, n: int, seed: int) -> DataFrame:
    """``n`` lines in key order, as a top-n over the distinct lines and then over their copies."""
    drawn = distinct.withColumn("_k", row_key(seed, stratum)).orderBy("_k").limit(n)
    return _up_to(drawn, n).orderBy("_k").limit(n).select(*COLUMNS, F.lit(stratum).alias("stratum"))


def stratified_sample(distinct: DataFrame, s: SampleSizes = SampleSizes()) -> DataFrame:
    """Lines of the busiest items, random lines, and some of every kind that cleaning removes.

    ``distinct`` holds each distinct line once with its number of ``copies``.
    """
    lines = distinct.select(*COLUMNS, "copies")
    cancelled, listed = is_cancelled(F.col("invoice")), is_non_product(F.col("stock_code"))
    product = lines.filter(~listed)
    busiest = (
        product.filter(~cancelled).groupBy("stock_code").agg(F.sum("copies").alias("n"))
        .orderBy(F.col("n").desc(), "stock_code").limit(s.focus_items)
    )
    focus = product.join(F.broadcast(busiest.select("stock_code")), "stock_code", "left_semi")
    # first within salted parts of each item, so that no task ranks all lines of a hot item
    keyed = focus.withColumn("_k", row_key(s.seed, "focus")).withColumn("_s", F.crc32(F.col("_k")) % _SALTS)
    for part in (["stock_code", "_s"], ["stock_code"]):
        order = Window.partitionBy(*part).orderBy("_k")
        keyed = keyed.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= s.focus_rows).drop("_r")
    once = Window.partitionBy("stock_code").orderBy("_k")  # at most focus_rows squared rows per item
    keyed = _up_to(keyed, s.focus_rows).withColumn("_r", F.row_number().over(once)).filter(F.col("_r") <= s.focus_rows)
    out = keyed.select(*COLUMNS, F.lit("focus").alias("stratum"))

    groups = (
        lines.filter(F.col("copies") > 1).withColumn("_k", row_key(s.seed, "duplicate"))
        .orderBy("_k").limit(s.duplicate_groups)
    )
    for part in (
        _some(lines, "random", s.random_rows, s.seed),
        _some(lines.filter(cancelled), "cancelled", s.cancellations, s.seed),
        _some(lines.filter(listed), "non-product", s.non_product, s.seed),
        _some(lines.filter(F.col("price") <= 0), "zero price", s.zero_price, s.seed),
        _whole(groups).withColumn("stratum", F.lit("duplicate")),
    ):
        out = out.unionByName(part)
    return out
