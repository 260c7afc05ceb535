"""Stage 4a: orders of the window, cartons, the crew log and its daily view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.operators import prefix
from orderloom.operators.prefix import (
    global_prefix, largest_group, queue_scan, rank_in_group,
)
from orderloom.operators.quantile import quantiles
from orderloom.params import DEFAULTS, Params

SLACK = 1e-9


def item_quantities(lines: DataFrame, physical: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Units per invoice and item with unit volume and weight.

    Packing treats equal units alike, so the lines of one item fold into one row before anything is
    gathered per invoice: at most ``n_items`` rows remain for any invoice.
    """
    unit = physical.select(
        "stock_code", (F.col("length_cm") * F.col("width_cm") * F.col("height_cm")).alias("unit_cm3"),
        F.col("weight_kg").alias("unit_kg"),
    )
    known = F.broadcast(unit) if p.n_items <= prefix.ONE_TASK_ROWS else unit
    folded = lines.groupBy("invoice", "stock_code").agg(
        F.sum("quantity").alias("quantity"), F.min("invoice_ts").alias("arrival")
    )
    return folded.join(known, "stock_code")


def _oversize(volume: Column, weight: Column, p: Params) -> Column:
    return (volume > p.carton_cm3) | (weight > p.carton_kg)


def _fit(volume: Column, weight: Column, unit: Column) -> Column:
    """Whole units that still go into the given space and weight."""
    by_volume = F.floor(volume / unit["unit_cm3"] + SLACK)
    by_weight = F.when(unit["unit_kg"] > 0, F.floor(weight / unit["unit_kg"] + SLACK)).otherwise(by_volume)
    return F.least(by_volume, by_weight)


def _run(volume: Column, weight: Column, n: Column) -> Column:
    return F.struct(volume.alias("v"), weight.alias("w"), n.cast("bigint").alias("n"))


def _split(run: Column, unit: Column, wanted: Column) -> Column:
    """Fill a run of equal cartons front to back with ``wanted`` units (at most what fits).

    The run becomes up to three: cartons filled, one filled in part, cartons untouched.
    """
    def worked(fit: Column) -> Column:
        full = F.when(fit > 0, F.floor(wanted / F.greatest(fit, F.lit(1)))).otherwise(0).cast("bigint")
        rest = wanted - full * fit
        part = F.when(rest > 0, 1).otherwise(0)
        return F.array(
            _run(run["v"] - fit * unit["unit_cm3"], run["w"] - fit * unit["unit_kg"], full),
            _run(run["v"] - rest * unit["unit_cm3"], run["w"] - rest * unit["unit_kg"], part),
            _run(run["v"], run["w"], run["n"] - full - part),
        )

    pieces = F.element_at(F.transform(F.array(_fit(run["v"], run["w"], unit)), worked), 1)
    return F.filter(pieces, lambda r: r["n"] > 0)


def _place(runs: Column, unit: Column, p: Params) -> Column:
    """Put all units of one item into the open cartons in order, then into new ones."""
    start = F.struct(unit["quantity"].alias("left"), F.filter(runs, lambda r: F.lit(False)).alias("out"))

    def into(state: Column, run: Column) -> Column:
        room = _fit(run["v"], run["w"], unit) * run["n"]
        taken = F.transform(F.array(F.least(state["left"], room)), lambda t: F.struct(
            (state["left"] - t).alias("left"),
            F.concat(state["out"], _split(run, unit, t)).alias("out"),
        ))
        return F.element_at(taken, 1)

    def close(state: Column) -> Column:
        fresh_fit = _fit(F.lit(p.carton_cm3), F.lit(p.carton_kg), unit)
        needed = F.ceil(state["left"] / fresh_fit)
        fresh = _run(F.lit(p.carton_cm3), F.lit(p.carton_kg), needed)
        return F.when(
            state["left"] > 0, F.concat(state["out"], _split(fresh, unit, state["left"]))
        ).otherwise(state["out"])

    return F.aggregate(runs, start, into, close)


def pack(quantities: DataFrame, p: Params = DEFAULTS, *also: Column) -> DataFrame:
    """Cartons per invoice: largest units first, each into the first carton with room; oversize alone.

    Open cartons with equal space left are held as one run with a count, so the state grows with the
    number of items and not with the quantity ordered. ``also`` are further aggregates per invoice.
    """
    too_big = _oversize(F.col("unit_cm3"), F.col("unit_kg"), p)
    wanted = F.col("quantity") > 0
    unit = F.struct(
        (-F.col("unit_cm3")).alias("_v"), (-F.col("unit_kg")).alias("_w"), "unit_cm3", "unit_kg", "quantity"
    )
    gathered = quantities.groupBy("invoice").agg(
        F.coalesce(F.sum(F.when(wanted & too_big, F.col("quantity"))), F.lit(0)).alias("_alone"),
        F.array_sort(F.collect_list(F.when(wanted & ~too_big, unit))).alias("_units"),
        *also,
    )
    none = F.filter(F.array(_run(F.lit(0.0), F.lit(0.0), F.lit(0))), lambda r: F.lit(False))
    packed = F.aggregate("_units", none, lambda runs, u: _place(runs, u, p))
    count = F.aggregate(packed, F.lit(0).cast("bigint"), lambda a, r: a + r["n"])
    return gathered.withColumn("cartons", F.col("_alone") + count).drop("_alone", "_units")


def cartons(quantities: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    return pack(quantities, p)


def carton_lower_bound(quantities: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """No packing can use fewer: volume and weight divided by the carton's, plus oversize units."""
    too_big = _oversize(F.col("unit_cm3"), F.col("unit_kg"), p)
    fits = F.when(too_big, 0).otherwise(F.col("quantity"))
    sums = quantities.groupBy("invoice").agg(
        F.sum(F.when(too_big, F.col("quantity")).otherwise(0)).alias("alone"),
        F.sum(fits * F.col("unit_cm3")).alias("cm3"),
        F.sum(fits * F.col("unit_kg")).alias("kg"),
    )
    least = F.greatest(
        F.ceil(F.col("cm3") / p.carton_cm3 - SLACK), F.ceil(F.col("kg") / p.carton_kg - SLACK)
    )
    return sums.select("invoice", (F.col("alone") + least).alias("least_cartons"))


def orders(quantities: DataFrame, picks: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """One row per invoice of the window: arrival, pick work, cartons and weight."""
    shipped = pack(
        quantities, p, F.min("arrival").alias("arrival"),
        F.sum(F.col("quantity") * F.col("unit_kg")).alias("weight_kg"),
    )
    work = picks.select("invoice", "lines", "units", F.col("time_min").alias("pick_minutes"))
    return shipped.join(work, "invoice").select(
        "invoice", "arrival", "pick_minutes", "lines", "units", "cartons", "weight_kg"
    )


def minute_of_day(ts: Column) -> Column:
    """Minutes since midnight, whatever zone the session is in."""
    return F.hour(ts) * 60 + F.minute(ts) + F.extract(F.lit("SECOND"), ts).cast("double") / 60.0


def fulfilment_log(orders_df: DataFrame, p: Params = DEFAULTS, mode: str = "lanes") -> DataFrame:
    """Start, finish, wait and shipping day of every order.

    ``ample``: work starts on arrival. ``lanes``: the orders of a day go to the crew in turn and each
    picker works a queue in arrival order, idle at the start of the day.
    """
    placed = orders_df.withColumn("arrival_day", F.to_date("arrival")).withColumn("_at", minute_of_day(F.col("arrival")))
    if mode == "ample":
        done = placed.withColumn("lane", F.lit(None).cast("bigint")).withColumn(
            "_end", F.col("_at") + F.col("pick_minutes")
        )
    elif mode == "lanes":
        order = [F.col("arrival"), F.col("invoice")]
        largest = largest_group(placed, ["arrival_day"])
        turned = rank_in_group(placed, ["arrival_day"], order, largest, "_turn")
        turned = turned.withColumn("lane", (F.col("_turn") - 1) % p.crew).drop("_turn")
        done = queue_scan(turned, ["arrival_day", "lane"], order, "_at", "pick_minutes", largest, "_end")
    else:
        raise ValueError(f"unknown crew mode: {mode}")
    first = orders_df.agg(F.min("arrival").alias("t")).scalar()
    shift = F.date_diff("arrival_day", F.to_date(first)) * 1440.0 - minute_of_day(first)
    begin = F.col("_end") - F.col("pick_minutes")
    return done.select(
        "invoice", "arrival", "arrival_day", "lane",
        begin.alias("start_of_day_min"), F.col("_end").alias("finish_of_day_min"),
        (begin + shift).alias("start_min"), (F.col("_end") + shift).alias("finish_min"),
        (begin - F.col("_at")).alias("wait_min"),
        "pick_minutes", "lines", "units", "cartons", "weight_kg",
        F.date_add("arrival_day", F.floor(F.col("_end") / 1440.0).cast("int")).alias("day"),
    )


def per_day(log: DataFrame) -> DataFrame:
    """Daily totals by shipping day (the day work finished)."""
    return log.groupBy("day").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("lines").alias("lines"),
        F.sum("units").alias("units"),
        (F.sum("pick_minutes") / 60.0).alias("labour_hours"),
        F.sum("cartons").alias("cartons"),
        F.sum("weight_kg").alias("weight_kg"),
    )


def concurrency_profile(log: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Per arrival day: most orders in progress at once, and the share that started above crew size.

    Starts and finishes of the same moment fold into one event row, finishes first. Every day begins
    and ends with nothing in progress, so one running sum over all days serves each of them.
    """
    moments = F.array(
        F.struct(F.round("start_of_day_min", 6).alias("t"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.round("finish_of_day_min", 6).alias("t"), F.lit(0).alias("up"), F.lit(1).alias("down")),
    )
    events = (
        log.select("arrival_day", F.inline(moments))
        .groupBy("arrival_day", "t")
        .agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        .withColumn("net", F.col("up") - F.col("down"))
    )
    running = global_prefix(events, [F.col("arrival_day"), F.col("t")], ["net"])
    above = F.greatest(F.lit(0), F.least(F.col("up"), F.col("cum_net") - p.crew))
    return running.groupBy("arrival_day").agg(
        F.sum("up").alias("orders"),
        F.max("cum_net").alias("peak_in_progress"),
        (F.sum(above) / F.sum("up")).alias("share_above_crew"),
    )


def quantile_aggs(column: str, rank: Column, at: dict[str, float]) -> list[Column]:
    out = []
    for name, q in at.items():
        place = q * (F.col("n_rows") - 1)
        low, weight = F.floor(place), place - F.floor(place)
        share = F.when(rank == low + 1, 1.0 - weight).when(rank == low + 2, weight)
        out.append(F.coalesce(F.sum(F.col(column) * share), F.lit(0.0)).alias(name))
    return out


def crew_summary(log: DataFrame, daily: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Labour hours, use of the crew's shift time, mean and 95th percentile wait."""
    waits = quantiles(log, "wait_min", {"p95": 0.95}).scalar()
    hours = daily.agg(F.count(F.lit(1)).alias("days"), F.sum("labour_hours").alias("labour_hours"))
    mean = log.agg(F.avg("wait_min").alias("m")).scalar()
    return hours.select(
        "days", F.coalesce("labour_hours", F.lit(0.0)).alias("labour_hours"),
        F.coalesce(
            F.try_divide(F.col("labour_hours"), F.col("days") * (p.crew * p.shift_hours)), F.lit(0.0)
        ).alias("utilisation"),
        F.coalesce(mean, F.lit(0.0)).alias("mean_wait_min"),
        F.coalesce(waits, F.lit(0.0)).alias("p95_wait_min"),
    )
