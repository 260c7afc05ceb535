"""Stage 2: base-stock replenishment per forecast item."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.expr import require
from orderloom.params import DEFAULTS, Params


def z_score(service_level: float) -> float:
    if not 0.0 < service_level < 1.0:
        raise ValueError("service level must lie strictly between 0 and 1")
    return NormalDist().inv_cdf(service_level)


def safety_stock(sigma: Column, weeks: Column, z: Column | float) -> Column:
    return (F.lit(z) if isinstance(z, float) else z) * F.sqrt(weeks.cast("double")) * sigma


def order_up_to(mu: Column, sigma: Column, weeks: Column, z: Column | float) -> Column:
    return mu * weeks + safety_stock(sigma, weeks, z)


def plan(
    forecasts: DataFrame, lead_times: DataFrame, p: Params = DEFAULTS, by: Sequence[str] = ()
) -> DataFrame:
    """One row per forecast item (and per value of the scenario columns in ``by``).

    An item without a lead time fails the job.
    """
    keys = [*by, "stock_code"]
    per_item = forecasts.groupBy(*keys).agg(
        F.min("class").alias("class"),
        F.min("model").alias("model"),
        F.avg("units").alias("mu_weekly"),
        F.max("sigma").alias("sigma"),
        F.min("week").alias("order_week"),
    )
    missing = F.concat(F.lit("no lead time for item "), F.col("stock_code"))
    joined = per_item.join(lead_times.select("stock_code", F.col("lead_time_weeks").cast("int")), "stock_code", "left")
    return _sized(require(joined, F.col("lead_time_weeks").isNotNull(), missing), keys, F.lit(z_score(p.service_level)), p)


def _sized(base: DataFrame, keys: Sequence[str], z: Column, p: Params) -> DataFrame:
    mu, sigma, lead = F.col("mu_weekly"), F.col("sigma"), F.col("lead_time_weeks")
    protection = lead + p.review_weeks
    stock = safety_stock(sigma, protection, z)
    level = mu * protection + stock
    return base.select(
        *keys, "class", "model", "mu_weekly", "sigma", "lead_time_weeks",
        stock.alias("safety_stock"),
        (mu * lead + safety_stock(sigma, lead, z)).alias("reorder_point"),
        level.alias("order_up_to"),
        level.alias("order_qty"),
        "order_week",
        (mu * (p.review_weeks / 2.0) + stock).alias("expected_stock"),
    )


def plan_by_level(plan_df: DataFrame, levels: Sequence[float], p: Params = DEFAULTS) -> DataFrame:
    """The same plan at several service levels; each item row fans out to one row per level."""
    options = F.array(
        *[F.struct(F.lit(v).alias("service_level"), F.lit(z_score(v)).alias("z")) for v in levels]
    )
    fanned = plan_df.withColumn("_o", F.explode(options)).select("*", "_o.service_level", "_o.z")
    return _sized(fanned, ["service_level", "stock_code"], F.col("z"), p)


def class_summary(plan_df: DataFrame) -> DataFrame:
    """Buffer per demand class; ratios are pooled over the class, with a floor on the divisor."""
    floor = F.greatest(F.col("mu_weekly"), F.lit(1e-9))
    return (
        plan_df.groupBy("class")
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.sum("mu_weekly").alias("mu_weekly"),
            F.sum("safety_stock").alias("safety_stock"),
            F.sum("order_up_to").alias("order_up_to"),
            F.avg("lead_time_weeks").alias("mean_lead"),
            F.sum("sigma").alias("_sigma"),
        )
        .select(
            "class", "items", "mu_weekly", "safety_stock", "order_up_to", "mean_lead",
            (F.col("_sigma") / floor).alias("sigma_over_mu"),
            (F.col("safety_stock") / floor).alias("ss_weeks"),
        )
    )
