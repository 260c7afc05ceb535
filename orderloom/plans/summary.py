"""One headline and the details of every stage of a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.functions.provenance import ASSIGNED, DERIVED, REAL
from orderloom.operators import costs, delivery, fulfil
from orderloom.plans.run import Run


def _stage(one: DataFrame, number: int, name: str, tag: str, label: str, value: str) -> DataFrame:
    """``one`` is a one-row frame: column ``value`` is the headline, the others are details."""
    pairs = [F.lit(c) if k == 0 else F.col(c).cast("double") for c in one.columns if c != value for k in (0, 1)]
    return one.select(
        F.lit(number).alias("stage_id"), F.lit(name).alias("name"), F.lit(tag).alias("provenance"),
        F.lit(label).alias("headline"), F.col(value).cast("double").alias("value"), F.create_map(*pairs).alias("detail"),
    )


def stage_summary(run: Run) -> DataFrame:
    p, base = run.params, run.ledger

    def from_ledger(**keys: str) -> DataFrame:
        return base.agg(*[F.max(F.when(F.col("key") == key, F.col("value"))).alias(c) for c, key in keys.items()])

    def count(df: DataFrame):
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()

    def log_value(step: int, column: str):
        return run.cleaning_log.filter(F.col("step_no") == step).select(column).scalar()

    ingest = from_ledger(revenue="ingest/revenue_gbp", tracked_lines="ingest/line_count", stream_lines="invoice_stream/line_count")
    ingest = ingest.withColumns(
        {
            "raw_rows": log_value(1, "rows_in"), "sales_rows": log_value(6, "rows_out"), "returns_rows": count(run.returns),
            "tracked_items": count(run.items), "weeks": count(run.weeks),
            "invoices": base.filter("key = 'warehouse/invoices_optimal'").select("value").scalar(),
        }
    )
    forecast = from_ledger(items="forecast/items", rows="forecast/rows").withColumns(
        {"horizon_weeks": F.lit(p.horizon), "classes_with_winner": count(run.class_winners.filter("winner"))}
    )
    stock = from_ledger(safety_stock="inventory/safety_stock_units", items_planned="inventory/plan_items").withColumns(
        {
            "order_up_to_units": run.plan.agg(F.sum("order_up_to").alias("s")).scalar(),
            "service_level": F.lit(p.service_level),
        }
    )
    picking = from_ledger(
        optimal_m="warehouse/travel_mean_optimal", abc_m="warehouse/travel_mean_abc", random_m="warehouse/travel_mean_random"
    )
    crew = fulfil.crew_summary(run.log, run.per_day, p).select("days", "labour_hours", "mean_wait_min", "p95_wait_min")
    shipped = from_ledger(
        orders="fulfil/orders", window_weeks="window/weeks", lines_picked="fulfil/picked_lines",
        cartons_shipped="fulfil/cartons_shipped",
    ).withColumns({"crew": F.lit(p.crew), "_c": crew.select(F.struct("*").alias("c")).scalar()}).select("*", "_c.*").drop("_c")
    record = delivery.method_record(run.delivery_daily).select(F.struct("*").alias("r")).scalar()
    road = run.delivery_daily.agg(
        F.sum("km").alias("km"), F.sum("hi_km").alias("out_and_back_km"), F.count(F.lit(1)).alias("delivery_days"),
        F.sum("vehicles").alias("vehicle_days"),
    ).withColumns(
        {"drops_routed": base.filter("key = 'transport/routed_drops'").select("value").scalar(), "_r": record}
    ).select("*", "_r.*").drop("_r")
    costing = from_ledger(
        total_cost="costing/total_cost", window_revenue="costing/window_revenue", labour="costing/labour",
        transport="costing/transport", holding="costing/holding", facility="costing/facility",
    ).withColumn("cost_pct", costs.cost_share_of_revenue(run.ledger_lines).select("cost_pct").scalar())
    parts = [
        _stage(ingest, 0, "ingest", REAL, "cleaned revenue (GBP)", "revenue"),
        _stage(forecast, 1, "forecast", DERIVED, "items forecast", "items"),
        _stage(stock, 2, "inventory", ASSIGNED, "safety stock (units)", "safety_stock"),
        _stage(picking, 3, "warehouse", ASSIGNED, "mean pick travel, deployed layout (m/invoice)", "optimal_m"),
        _stage(shipped, 4, "fulfilment", ASSIGNED, "orders shipped in the window", "orders"),
        _stage(road, 5, "transport", ASSIGNED, "route km in the window", "km"),
        _stage(costing, 6, "costing", ASSIGNED, "modelled cost of the window (GBP)", "total_cost"),
    ]
    return reduce(DataFrame.unionByName, parts)
