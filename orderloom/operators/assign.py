"""Assigned (not observed) attributes: sizes, lead times, racks, customer places. All draws are keyed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.functions.expr import keyed_uniform, required, size_class
from orderloom.params import DEFAULTS, HOME_COUNTRY, Params

# Uniform ranges per size class (cm, cm, cm, kg).
SIZE_RANGES = {
    "small": {"length_cm": (5, 15), "width_cm": (4, 12), "height_cm": (3, 10), "weight_kg": (0.05, 0.40)},
    "medium": {"length_cm": (15, 35), "width_cm": (10, 25), "height_cm": (8, 20), "weight_kg": (0.30, 2.00)},
    "large": {"length_cm": (35, 70), "width_cm": (25, 50), "height_cm": (20, 45), "weight_kg": (1.50, 8.00)},
}
# Base weeks per demand class; a draw adds 0 or 1.
LEAD_BASE = {"smooth": 2, "erratic": 3, "intermittent": 4, "lumpy": 4, "unclassified": 3}
# Rack geometry in metres.
AISLE_PITCH, BAY_PITCH, FRONT_OFFSET, BAYS_PER_AISLE = 3.0, 1.2, 4.0, 25


def item_physical(descriptions: DataFrame, seed: int = DEFAULTS.seed) -> DataFrame:
    """Size class from the description, then keyed uniform dimensions and weight."""
    sized = descriptions.withColumn("size_class", size_class(F.col("description")))

    def draw(name: str) -> Column:
        lo, hi = (
            F.element_at(F.create_map(*[F.lit(x) for c, r in SIZE_RANGES.items() for x in (c, float(r[name][k]))]),
                         F.col("size_class"))
            for k in (0, 1)
        )
        digits = 3 if name == "weight_kg" else 1
        return F.round(lo + (hi - lo) * keyed_uniform(seed, name, F.col("stock_code")), digits).alias(name)

    return sized.select("stock_code", "size_class", *[draw(c) for c in SIZE_RANGES["small"]])


def lead_times(items: DataFrame, forecasts: DataFrame, seed: int = DEFAULTS.seed) -> DataFrame:
    """Weeks per tracked item; items without a forecast count as unclassified."""
    known = forecasts.groupBy("stock_code").agg(F.min("class").alias("class"))
    labelled = items.select("stock_code").join(known, "stock_code", "left").fillna("unclassified", ["class"])
    table = F.create_map(*[F.lit(x) for pair in LEAD_BASE.items() for x in pair])
    base = F.coalesce(F.try_element_at(table, F.col("class")), F.lit(LEAD_BASE["unclassified"]))
    jitter = F.floor(keyed_uniform(seed + 1, "lead", F.col("stock_code")) * 2).cast("int")
    return labelled.select("stock_code", "class", (base + jitter).alias("lead_time_weeks"))


def _rack(slots: DataFrame) -> DataFrame:
    placed = slots.select(
        "slot_id",
        F.floor(F.col("slot_id") / BAYS_PER_AISLE).cast("int").alias("aisle"),
        (F.col("slot_id") % BAYS_PER_AISLE).alias("bay"),
    )
    x, y = F.col("aisle") * AISLE_PITCH, F.lit(FRONT_OFFSET) + F.col("bay") * BAY_PITCH
    return placed.select(
        "slot_id", "aisle", "bay",
        F.round(x, 2).alias("x_m"), F.round(y, 2).alias("y_m"), F.round(x + y, 2).alias("distance_m"),
    )


def make_slots(spark: SparkSession, min_slots: int) -> DataFrame:
    """Whole aisles with room for ``min_slots``; distance is the one-way walk from dispatch."""
    if min_slots < 1:
        raise ValueError("at least one slot is needed")
    aisles = math.ceil(min_slots / BAYS_PER_AISLE)
    return _rack(spark.range(aisles * BAYS_PER_AISLE).select(F.col("id").cast("int").alias("slot_id")))


def slots_for(items: DataFrame) -> DataFrame:
    """Whole aisles with room for every tracked item; no items at all fails the job."""
    need = items.agg(F.nullif(F.count(F.lit(1)), F.lit(0)).alias("n"))
    aisles = F.ceil(required(F.col("n"), "bigint", "at least one slot is needed") / BAYS_PER_AISLE)
    last = (aisles * BAYS_PER_AISLE - 1).cast("int")
    return _rack(need.select(F.explode(F.sequence(F.lit(0), last)).alias("slot_id")))


def customer_lookup(sales: DataFrame) -> DataFrame:
    """Customer key and country per invoice, each the first non-null value by time.

    Unknown customers get one guest key per invoice, so their orders are still delivered.
    """

    def first_known(name: str) -> Column:
        seen = F.when(F.col(name).isNotNull(), F.struct(F.col("t"), F.col(name).alias("v")))
        return F.min(seen)["v"]

    # the least struct needs sorted rows, so all lines first fold to one row per invoice, customer and country
    folded = sales.groupBy("invoice", "customer_id", "country").agg(F.min("invoice_ts").alias("t"))
    firsts = folded.groupBy("invoice").agg(
        first_known("customer_id").alias("_id"), first_known("country").alias("country")
    )
    key = F.coalesce(F.concat(F.lit("cust:"), F.col("_id").cast("string")), F.concat(F.lit("guest:"), "invoice"))
    return firsts.select("invoice", key.alias("customer_key"), "country")


def with_customer_xy(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Area-uniform place in the distance band of the country (NULL country counts as export)."""
    home = F.coalesce(F.col("country") == HOME_COUNTRY, F.lit(False))
    lo = F.when(home, p.home_band_km[0]).otherwise(p.export_band_km[0])
    hi = F.when(home, p.home_band_km[1]).otherwise(p.export_band_km[1])
    area = keyed_uniform(p.seed, "radius", F.col("customer_key"))
    angle = keyed_uniform(p.seed, "angle", F.col("customer_key")) * (2.0 * math.pi)
    radius = F.sqrt(lo * lo + (hi * hi - lo * lo) * area)
    return (
        df.withColumn("_r", radius).withColumn("_a", angle)
        .withColumn("x_km", F.col("_r") * F.cos("_a"))
        .withColumn("y_km", F.col("_r") * F.sin("_a"))
        .drop("_r", "_a")
    )
