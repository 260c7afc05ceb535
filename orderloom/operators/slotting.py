"""Stage 3: slot assignment and pick tours, all layout variants in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.expr import keyed_uniform, require
from orderloom.operators import prefix
from orderloom.operators.prefix import rank_rows
from orderloom.params import DEFAULTS, VARIANTS, Params


def velocity(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Invoice lines per item, 0 if it was never picked."""
    counts = lines.groupBy("stock_code").agg(F.count(F.lit(1)).alias("velocity"))
    return items.select("stock_code").join(counts, "stock_code", "left").fillna(0, ["velocity"])


def slot(items_velocity: DataFrame, slots: DataFrame, n_items: int, seed: int = DEFAULTS.seed) -> DataFrame:
    """One slot per item and variant, by matching ranks.

    random: items by code against slots in keyed random order. abc: most picked item to nearest slot.
    optimal: the same matching, which by the rearrangement inequality minimises the sum of
    velocity x distance; ties among equal velocities fall the other way.
    """
    busy = F.col("velocity").desc()
    item_orders = {
        "random": [F.col("stock_code").asc()],
        "abc": [busy, F.col("stock_code").asc()],
        "optimal": [busy, F.col("stock_code").desc()],
    }
    slot_orders = {
        "shuffled": [keyed_uniform(seed + 2, "slot", F.col("slot_id")), F.col("slot_id")],
        "near": [F.col("distance_m"), F.col("slot_id")],
    }
    ranked_items = items_velocity.select("stock_code", "velocity")
    for name, order in item_orders.items():
        ranked_items = rank_rows(ranked_items, order, n_items, f"by_{name}")
    ranked_slots = slots.select("slot_id", "distance_m")
    for name, order in slot_orders.items():
        ranked_slots = rank_rows(ranked_slots, order, 2 * n_items + 25, f"by_{name}")

    places = ranked_items.select(
        "stock_code",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(v).alias("variant"),
                        F.lit("shuffled" if v == "random" else "near").alias("kind"),
                        F.col(f"by_{v}").alias("place"),
                    )
                    for v in VARIANTS
                ]
            )
        ),
    )
    targets = ranked_slots.select(
        "slot_id",
        F.inline(
            F.array(
                *[F.struct(F.lit(k).alias("kind"), F.col(f"by_{k}").alias("place")) for k in slot_orders]
            )
        ),
    )
    matched = places.join(targets, ["kind", "place"], "left")
    full = require(matched, F.col("slot_id").isNotNull(), F.lit("fewer slots than tracked items"))
    return full.select("variant", "stock_code", "slot_id")


def slotting_table(slotting: DataFrame, slots: DataFrame, items_velocity: DataFrame, variant: str) -> DataFrame:
    """Item, slot, distance and velocity of one layout."""
    return (
        slotting.filter(F.col("variant") == variant)
        .join(slots.select("slot_id", "distance_m"), "slot_id")
        .join(items_velocity, "stock_code")
        .select("stock_code", "slot_id", "distance_m", F.col("velocity").alias("velocity_lines"))
    )


def objective(slotting: DataFrame, slots: DataFrame, items_velocity: DataFrame) -> DataFrame:
    """Sum of velocity x distance per variant."""
    return (
        slotting.join(slots.select("slot_id", "distance_m"), "slot_id")
        .join(items_velocity, "stock_code")
        .groupBy("variant")
        .agg(F.sum(F.col("velocity") * F.col("distance_m")).alias("weighted_m"))
    )


def slot_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Along the aisle inside one aisle, else out to the front, across and in again.

    Dispatch is the point (0, 0) under the same rule.
    """
    return F.when(x1 == x2, F.abs(y1 - y2)).otherwise(F.abs(x1 - x2) + y1 + y2)


def tour_length(stops: Column) -> Column:
    """Nearest-neighbour walk from dispatch over all ``stops`` and back; ties go to the lower slot.

    ``stops`` is an array of struct(slot_id, x, y) in whole centimetres, so equal distances are equal.
    """
    start = F.struct(
        F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"),
        F.lit(0).cast("bigint").alias("walked"), stops.alias("left"),
    )

    def step(state: Column, _unused: Column) -> Column:
        nearest = F.array_min(
            F.transform(
                state["left"],
                lambda s: F.struct(
                    slot_distance(state["x"], state["y"], s["x"], s["y"]).alias("d"),
                    s["slot_id"].alias("slot_id"), s["x"].alias("x"), s["y"].alias("y"),
                ),
            )
        )
        # the one-element transform names the chosen stop, so it is worked out once per step
        moved = F.transform(
            F.array(nearest),
            lambda c: F.struct(
                c["x"].alias("x"), c["y"].alias("y"), (state["walked"] + c["d"]).alias("walked"),
                F.filter(state["left"], lambda s: s["slot_id"] != c["slot_id"]).alias("left"),
            ),
        )
        return F.element_at(moved, 1)

    return F.aggregate(stops, start, step, lambda s: s["walked"] + s["x"] + s["y"])


def evaluate(lines: DataFrame, slotting: DataFrame, slots: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Lines, units, metres and minutes per variant and invoice.

    One shuffle by invoice for all variants. Each item has its own slot, so an invoice holds at most
    ``n_items`` distinct stops however many lines it has, and the map side already drops repeats.
    """
    at = slots.select(
        "slot_id",
        F.round(F.col("x_m") * 100).cast("bigint").alias("x"),
        F.round(F.col("y_m") * 100).cast("bigint").alias("y"),
    )
    stops = slotting.join(at, "slot_id").groupBy("stock_code").pivot("variant", list(VARIANTS)).agg(
        F.first(F.struct("slot_id", "x", "y"))
    )
    known = F.broadcast(stops) if p.n_items <= prefix.ONE_TASK_ROWS else stops
    picked = lines.join(known, "stock_code")
    per_invoice = picked.groupBy("invoice").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("quantity").cast("double").alias("units"),
        F.collect_set(F.struct(*VARIANTS)).alias("stops"),
    )
    fanned = per_invoice.select(
        "invoice", "lines", "units",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(v).alias("variant"),
                        F.col("stops").getField(v).alias("own"),
                    )
                    for v in VARIANTS
                ]
            )
        ),
    )
    walked = fanned.select(
        "variant", "invoice", "lines", "units", (tour_length(F.col("own")) / 100.0).alias("travel_m")
    )
    minutes = (F.col("travel_m") / p.walk_m_per_s + F.col("lines") * p.line_handle_s) / 60.0
    return walked.withColumn("time_min", minutes)


def summary(evaluated: DataFrame) -> DataFrame:
    """Per variant: invoices, lines, mean and total travel, and the change against random."""
    totals = evaluated.groupBy("variant").agg(
        F.count(F.lit(1)).alias("invoices"),
        F.sum("lines").alias("lines"),
        F.avg("travel_m").alias("mean_travel_m"),
        F.sum("travel_m").alias("total_travel_m"),
    )
    base = totals.filter(F.col("variant") == "random").select("mean_travel_m").scalar()
    change = F.coalesce(F.try_divide(100.0 * (F.col("mean_travel_m") - base), base), F.lit(0.0))
    return totals.withColumn("delta_vs_random_pct", change)
