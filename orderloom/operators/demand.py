"""Stage 0b: tracked items, week calendar, zero-filled weekly demand, invoice lines, busiest window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.expr import week_end
from orderloom.operators import prefix
from orderloom.operators.prefix import rank_rows


def _lookup(df: DataFrame, bound: int) -> DataFrame:
    """Hint a broadcast only where the row count is bounded by construction and small."""
    return F.broadcast(df) if bound <= prefix.ONE_TASK_ROWS else df


def tracked_items(sales: DataFrame, n: int) -> DataFrame:
    """The ``n`` items with most revenue, ties by code; ``rank`` 1 is the largest."""
    revenue = sales.groupBy("stock_code").agg(F.sum("revenue").alias("revenue"))
    order = [F.col("revenue").desc(), F.col("stock_code").asc()]
    return rank_rows(revenue.orderBy(*order).limit(n), order, n)


def weekly_index(sales: DataFrame) -> DataFrame:
    """Every week from first to last sale, both end weeks dropped even when complete."""
    ends = sales.agg(
        F.date_add(F.min(week_end(F.col("invoice_ts"))), 7).alias("lo"),
        F.date_sub(F.max(week_end(F.col("invoice_ts"))), 7).alias("hi"),
    ).filter(F.col("lo") <= F.col("hi"))
    weeks = F.sequence("lo", "hi", F.expr("interval 7 days"))
    return ends.select(F.posexplode(weeks).alias("idx", "week")).select("week", "idx")


def week_bounds(weeks: DataFrame) -> tuple[Column, Column]:
    """First and last week as scalar subqueries, so they reach filters as constants."""
    return (
        weeks.agg(F.min("week").alias("lo")).scalar(),
        weeks.agg(F.max("week").alias("hi")).scalar(),
    )


def sales_in_window(sales: DataFrame, items: DataFrame, weeks: DataFrame, n_items: int) -> DataFrame:
    """Sales of the tracked items whose week lies inside the range of ``weeks``."""
    lo, hi = week_bounds(weeks)
    dated = sales.withColumn("week", week_end(F.col("invoice_ts")))
    inside = dated.filter((F.col("week") >= lo) & (F.col("week") <= hi))
    return inside.join(_lookup(items.select("stock_code"), n_items), "stock_code", "left_semi")


def range_flags(sales: DataFrame, items: DataFrame, n_items: int, **ranges: DataFrame) -> DataFrame:
    """All sales with a flag per range: a tracked item's line whose week lies inside the range's weeks."""
    known = items.select("stock_code", F.lit(True).alias("_known"))
    dated = sales.withColumn("week", week_end(F.col("invoice_ts"))).join(_lookup(known, n_items), "stock_code", "left")
    flags = {}
    for name, weeks in ranges.items():
        lo, hi = week_bounds(weeks)
        flags[name] = F.coalesce(F.col("_known") & (F.col("week") >= lo) & (F.col("week") <= hi), F.lit(False))
    return dated.withColumns(flags).drop("_known")


def weekly_demand(sales: DataFrame, items: DataFrame, weeks: DataFrame, n_items: int) -> DataFrame:
    """Units per item and week, zero-filled from the first non-zero week to the calendar's end.

    The calendar is generated per item from its own start; an item without a sale inside the
    calendar keeps a row of zeros for every week.
    """
    lo, hi = week_bounds(weeks)
    sold = (
        sales_in_window(sales, items, weeks, n_items)
        .groupBy("stock_code", "week")
        .agg(F.sum("quantity").cast("double").alias("sold"))
    )
    starts = sold.filter(F.col("sold") != 0).groupBy("stock_code").agg(F.min("week").alias("start"))
    spans = items.select("stock_code").join(starts, "stock_code", "left")
    spans = spans.select("stock_code", F.coalesce("start", lo).alias("start")).filter(F.col("start") <= hi)
    grid = spans.select(
        "stock_code",
        F.posexplode(F.sequence(F.col("start"), hi, F.expr("interval 7 days"))).alias("idx", "week"),
    )
    return grid.join(sold, ["stock_code", "week"], "left").select(
        "stock_code", "week", "idx", F.coalesce("sold", F.lit(0.0)).alias("units")
    )


def series(demand: DataFrame) -> DataFrame:
    """One vector per item, in week order; its length is bounded by the calendar."""
    packed = F.array_sort(F.collect_list(F.struct("week", "units")))
    return demand.groupBy("stock_code").agg(packed.alias("_s")).select(
        "stock_code",
        F.transform("_s", lambda s: s["units"]).alias("y"),
        F.element_at("_s", -1)["week"].alias("last_week"),
    )


def invoice_lines(sales: DataFrame, items: DataFrame, weeks: DataFrame, n_items: int) -> DataFrame:
    return sales_in_window(sales, items, weeks, n_items).select(
        "invoice", "stock_code", "quantity", "invoice_ts", "week"
    )


def line_counts(sales: DataFrame, lines: DataFrame, items: DataFrame) -> DataFrame:
    """Lines, invoices and the share of all revenue that the tracked items carry."""
    total = sales.agg(F.sum("revenue").cast("double").alias("r")).scalar()
    tracked = items.agg(F.sum("revenue").cast("double").alias("r")).scalar()
    return lines.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_distinct("invoice").alias("invoices"),
    ).select("lines", "invoices", F.coalesce(F.try_divide(tracked, total), F.lit(0.0)).alias("tracked_share"))


def busiest_window(lines: DataFrame, weeks: DataFrame, n: int) -> DataFrame:
    """The ``n`` consecutive weeks with most lines; ties take the earliest, a short calendar is kept whole."""
    per_week = lines.groupBy("week").agg(F.count(F.lit(1)).alias("lines"))
    calendar = weeks.select("week").join(per_week, "week", "left").fillna(0, ["lines"])
    # one row per calendar week, so a single ordered frame is small
    ahead = Window.orderBy("week").rowsBetween(0, n - 1)
    whole = Window.orderBy("week").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    framed = calendar.select(
        "week",
        F.sum("lines").over(ahead).alias("total"),
        F.count(F.lit(1)).over(ahead).alias("span"),
        F.count(F.lit(1)).over(whole).alias("n_weeks"),
    ).filter(F.col("span") == F.least(F.lit(n), F.col("n_weeks")))
    start = framed.orderBy(F.col("total").desc(), F.col("week")).limit(1).select("week").scalar()
    return weeks.filter((F.col("week") >= start) & (F.col("week") < F.date_add(start, 7 * n))).select("week")


def window_lines(lines: DataFrame, window: DataFrame) -> DataFrame:
    """Lines whose week is a member of ``window`` (at most one row per calendar week)."""
    return lines.join(F.broadcast(window.select("week")), "week", "left_semi").select(*lines.columns)


def modal_description(sales: DataFrame, items: DataFrame, n_items: int) -> DataFrame:
    """Most frequent text per item, ties by text; '' when an item has none."""
    texts = (
        sales.filter(F.col("description").isNotNull())
        .join(_lookup(items.select("stock_code"), n_items), "stock_code", "left_semi")
        .groupBy("stock_code", "description")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = texts.groupBy("stock_code").agg(
        F.min(F.struct((-F.col("n")).alias("m"), F.col("description").alias("d")))["d"].alias("description")
    )
    return items.select("stock_code").join(best, "stock_code", "left").fillna("", ["description"])
