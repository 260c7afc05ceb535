"""Stage 5: cost allocation over orders and items, and the cost ledger of the window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.expr import week_end
from orderloom.functions.provenance import ASSIGNED, REAL
from orderloom.operators import prefix

from orderloom.params import COST_RATES, DEFAULTS, Params

COST_LINES = tuple(r.line for r in COST_RATES)


def charges(quantity: dict[str, Column], weeks: Column, p: Params = DEFAULTS, factor: dict[str, Column] | None = None) -> dict[str, Column]:
    """Amount per cost line from the quantity each grows with; ``factor`` scales a line's price."""
    out = {}
    for rate in COST_RATES:
        price = F.lit(getattr(p, rate.price))
        amount = quantity[rate.line] * (price * factor[rate.line] if factor else price)
        out[rate.line] = amount * weeks if rate.weekly else amount
    return out


def window_revenue_lines(sales: DataFrame, items: DataFrame, window: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Sales of tracked items in the window's weeks.

    Deliberately its own filter (week membership, not a range): the reconciliation compares it with
    the range filter of the demand stage.
    """
    known = items.select("stock_code")
    known = F.broadcast(known) if p.n_items <= prefix.ONE_TASK_ROWS else known
    return (
        sales.withColumn("week", week_end(F.col("invoice_ts")))
        .join(F.broadcast(window.select("week")), "week", "left_semi")  # one row per calendar week
        .join(known, "stock_code", "left_semi")
    )


def count_of(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def per_invoice(
    log: DataFrame, revenue_lines: DataFrame, delivery_daily: DataFrame, window: DataFrame, p: Params = DEFAULTS
) -> DataFrame:
    """Own pick minutes, carton share of the day's distance, and an equal share of the facility."""
    revenue = revenue_lines.groupBy("invoice").agg(F.sum("revenue").cast("double").alias("revenue"))
    daily = delivery_daily.select("day", F.col("cartons").alias("_day_cartons"), F.col("km").alias("_day_km"))
    share = F.try_divide(F.col("cartons").cast("double"), F.col("_day_cartons"))
    facility = F.lit(p.facility_per_week) * count_of(window)
    return (
        log.select("invoice", "day", "pick_minutes", "cartons")
        .join(revenue, "invoice", "left")
        .join(daily, "day", "left")
        .select(
            "invoice", "day", "revenue",
            (F.col("pick_minutes") / 60.0 * p.labour_per_hour).alias("labour_cost"),
            (share * F.col("_day_km") * p.transport_per_km).alias("transport_cost"),
            F.try_divide(facility, count_of(log)).alias("facility_cost"),
        )
    )


def per_item(
    items: DataFrame, revenue_lines: DataFrame, plan: DataFrame, window: DataFrame, p: Params = DEFAULTS
) -> DataFrame:
    """Revenue, units and holding per tracked item; without a plan the item holds nothing."""
    sold = revenue_lines.groupBy("stock_code").agg(
        F.sum("revenue").cast("double").alias("revenue"), F.sum("quantity").cast("double").alias("units")
    )
    return (
        items.select("stock_code")
        .join(sold, "stock_code", "left")
        .join(plan.select("stock_code", "safety_stock"), "stock_code", "left")
        .fillna(0.0, ["revenue", "units", "safety_stock"])
        .withColumn("holding_cost", F.col("safety_stock") * p.holding_per_unit_week * count_of(window))
    )


def ledger_lines(
    fulfil_daily: DataFrame, delivery_daily: DataFrame, items_cost: DataFrame, revenue_lines: DataFrame,
    window: DataFrame, p: Params = DEFAULTS,
) -> DataFrame:
    """Six lines: four costs, their total and the window's revenue, with basis and provenance."""
    hours = fulfil_daily.agg(F.coalesce(F.sum("labour_hours"), F.lit(0.0)).alias("v")).scalar()
    km = delivery_daily.agg(F.coalesce(F.sum("km"), F.lit(0.0)).alias("v")).scalar()
    revenue = revenue_lines.agg(F.coalesce(F.sum("revenue").cast("double"), F.lit(0.0)).alias("v")).scalar()
    base = items_cost.agg(
        F.coalesce(F.sum("holding_cost"), F.lit(0.0)).alias("holding"),
        F.coalesce(F.sum("safety_stock"), F.lit(0.0)).alias("stock"),
    )
    amounts = base.select(
        "holding", "stock", hours.alias("hours"), km.alias("km"), revenue.alias("revenue"),
        count_of(window).alias("weeks"),
    )
    priced = charges({"labour": F.col("hours"), "transport": F.col("km"), "holding": F.col("stock"), "facility": F.col("weeks")}, F.col("weeks"), p)
    # holding is what the items add up to, the other lines come from their one quantity
    amounts = amounts.withColumns({line: gbp for line, gbp in priced.items() if line != "holding"})
    total = F.col("labour") + F.col("transport") + F.col("holding") + F.col("facility")

    def text(pattern: str, *values: Column) -> Column:
        return F.format_string(pattern, *values)

    lines = [
        ("labour", F.col("labour"), text(f"%.1f picking hours x {p.labour_per_hour:.2f}/h", F.col("hours")), ASSIGNED),
        ("transport", F.col("transport"), text(f"%.1f km x {p.transport_per_km:.2f}/km", F.col("km")), ASSIGNED),
        ("holding", F.col("holding"),
         text(f"%.0f units x {p.holding_per_unit_week:.2f}/unit-week x %d weeks", F.col("stock"), F.col("weeks")),
         ASSIGNED),
        ("facility", F.col("facility"), text(f"{p.facility_per_week:.0f}/week x %d weeks", F.col("weeks")), ASSIGNED),
        ("total cost", total, F.lit("sum of the four cost lines"), ASSIGNED),
        ("window revenue", F.col("revenue"), text("sales of the same %d weeks", F.col("weeks")), REAL),
    ]
    return amounts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(item).alias("item"), value.alias("gbp"), basis.alias("basis"),
                        F.lit(tag).alias("provenance"),
                    )
                    for item, value, basis, tag in lines
                ]
            )
        )
    )


def cost_share_of_revenue(lines: DataFrame) -> DataFrame:
    """Total cost as percent of the window's revenue; 0 without revenue."""
    cost = F.sum(F.when(F.col("item") == "total cost", F.col("gbp")))
    revenue = F.sum(F.when(F.col("item") == "window revenue", F.col("gbp")))
    ratio = F.when(revenue != 0, F.try_divide(cost, revenue)).otherwise(0.0)
    return lines.agg(cost.alias("total_cost"), revenue.alias("window_revenue"), (100.0 * ratio).alias("cost_pct"))
