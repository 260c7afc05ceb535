"""Stage 4b: shipments, full loads, savings routes per day, distances and bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.operators import routing
from orderloom.operators.assign import with_customer_xy
from orderloom.operators.prefix import largest_group, rank_in_group
from orderloom.params import DEFAULTS, Params
from orderloom.sources.stage import StageTables

_BLOCK = 4096
TIE_KM = 1e-6
DAY_IN_TASK = 1500  # drops of a day that one task plans; its table of pairs has as many rows squared, halved


def shipments(log: DataFrame, lookup: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Order with customer, place and load: full vehicles go out and back, the rest becomes a drop."""
    joined = log.select("invoice", "day", F.col("cartons").alias("packed")).join(lookup, "invoice")
    placed = with_customer_xy(joined, p)
    placed = placed.withColumn("cartons", F.greatest(F.lit(1), F.col("packed")).cast("bigint"))
    placed = placed.withColumn("full_trips", F.floor(F.col("cartons") / p.vehicle_cartons)).withColumn(
        "rem", F.col("cartons") % p.vehicle_cartons
    )
    away = F.hypot("x_km", "y_km")
    return placed.select(
        "invoice", "day", "customer_key", "country", "x_km", "y_km", "packed", "cartons", "full_trips", "rem",
        ((F.col("rem") > 0) | (F.col("full_trips") == 0)).alias("is_node"),
        (2.0 * away * F.col("full_trips")).alias("direct_km"),
    )


def drops(shipments_df: DataFrame) -> DataFrame:
    """Drops to be routed, numbered by invoice within their day."""
    nodes = shipments_df.filter("is_node").select("day", "invoice", "x_km", "y_km", F.col("rem").cast("int").alias("load"))
    return rank_in_group(nodes, ["day"], [F.col("invoice")], largest_group(nodes, ["day"]), "k")


def _by_size(nodes: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Days that fit one task and larger ones; the plan is the same, the way to it differs."""
    sizes = nodes.groupBy("day").count()
    if sizes.filter(F.col("count") > DAY_IN_TASK).limit(1).count() == 0:
        return nodes, None
    large = sizes.filter(F.col("count") > DAY_IN_TASK).select("day")
    return nodes.join(large, "day", "left_anti"), nodes.join(large, "day", "left_semi")


def _pair_savings(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    home = np.sqrt(x * x + y * y)
    apart = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2)
    return home[:, None] + home - apart


def merge_by_savings(x: np.ndarray, y: np.ndarray, load: np.ndarray, capacity: int) -> list[list[int]]:
    """Join route ends in order of distance saved while the joint load fits; indices are 0-based."""
    n = len(x)
    gain = _pair_savings(x, y)
    first, second = np.triu_indices(n, 1)
    worth = gain[first, second]
    useful = worth > 0
    first, second, worth = first[useful], second[useful], worth[useful]
    ranked = np.lexsort((second, first, worth))[::-1]
    first, second = first[ranked], second[ranked]

    chains = {k: [k] for k in range(n)}
    owner, weight, open_end = np.arange(n), np.array(load, dtype=np.int64), np.ones(n, dtype=bool)

    def joinable(a, b):
        u, v = owner[a], owner[b]
        return open_end[a] & open_end[b] & (u != v) & (weight[u] + weight[v] <= capacity)

    for at in range(0, len(first), _BLOCK):
        block_a, block_b = first[at : at + _BLOCK], second[at : at + _BLOCK]
        alive = np.flatnonzero(joinable(block_a, block_b))  # pairs ruled out once stay ruled out
        for a, b in zip(block_a[alive].tolist(), block_b[alive].tolist()):
            if not joinable(a, b):
                continue
            keep, gone = int(owner[a]), int(owner[b])
            head, tail = chains[keep], chains.pop(gone)
            head = head[::-1] if head[0] == a else head
            tail = tail[::-1] if tail[-1] == b else tail
            chains[keep] = joined = head + tail
            owner[tail] = keep
            weight[keep] += weight[gone]
            open_end[[a, b]] = False
            open_end[[joined[0], joined[-1]]] = True
    return list(chains.values())


def savings_routes(nodes: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Vehicle routes of whole days, one row per drop in visiting order, from the end that sorts first.

    A day of a size that fits a task is planned there; larger ones are merged in rounds over all their drops (``routing``).
    """
    capacity = p.vehicle_cartons

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable").reset_index(drop=True)
        routes = merge_by_savings(
            pdf["x_km"].to_numpy(), pdf["y_km"].to_numpy(), pdf["load"].to_numpy(), capacity
        )
        routes = [r if r[0] <= r[-1] else r[::-1] for r in routes]
        visits = [(min(route), s, k) for route in routes for s, k in enumerate(route)]
        route, seq, node = (np.array(c, dtype=np.int64) for c in zip(*visits))
        return pd.DataFrame(
            {
                "day": pdf["day"].iloc[0],
                "route": pdf["k"].to_numpy()[route],
                "seq": seq.astype("int32"),
                "invoice": pdf["invoice"].to_numpy()[node],
            }
        )

    small, large = _by_size(nodes)
    planned = small.groupBy("day").applyInPandas(plan, "day date, route bigint, seq int, invoice string")
    if large is None:
        return planned
    merged = routing.merge_in_rounds(large.select("day", "k", "x_km", "y_km", F.col("load").cast("bigint").alias("load")), capacity)
    return planned.unionByName(merged.join(large.select("day", "k", "invoice"), ["day", "k"]).drop("k"))


def sweep_routes(nodes: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Routes by bearing from the depot, one row per drop in visiting order: the plan that savings are compared with."""
    swept = routing.sweep(nodes.withColumn("load", F.col("load").cast("bigint")), p.vehicle_cartons)
    return swept.join(nodes.select("day", "k", "invoice"), ["day", "k"]).select("day", "route", "seq", "invoice")


def plans_by_day(daily: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """Distance and vehicles of two plans of the same drops, both as ``per_day`` gives them; the second's columns begin with ``name``."""
    second = other.select("day", F.col("km").alias(f"{name}_km"), F.col("vehicles").alias(f"{name}_vehicles"))
    return daily.select("day", "drops", "km", "vehicles").join(second, "day")


def best_savings(nodes: DataFrame) -> DataFrame:
    """For each drop the partner of its day it saves most with, if any saving is positive; one row per drop at most.

    Savings are compared at 6 decimals, equal ones take the partner that sorts last.
    """

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable").reset_index(drop=True)
        gain = np.round(_pair_savings(pdf["x_km"].to_numpy(), pdf["y_km"].to_numpy()), 6)
        np.fill_diagonal(gain, -np.inf)
        n = len(pdf)
        partner = n - 1 - np.argmax(gain[:, ::-1], axis=1)
        saved = gain[np.arange(n), partner]
        names = pdf["invoice"].to_numpy()
        out = pdf[["day", "invoice"]].assign(partner=names[partner], saving_km=saved)
        return out[saved > 0]

    small, large = _by_size(nodes)
    found = small.groupBy("day").applyInPandas(rank, "day date, invoice string, partner string, saving_km double")
    return found if large is None else found.unionByName(_best_of_large_days(large))


def _best_of_large_days(nodes: DataFrame) -> DataFrame:
    """Best partners by places: drops at one place differ only in their number, so a place speaks through its last drop.

    A drop's own place offers its last drop, or its last but one to that drop itself.
    """
    stage = StageTables(nodes.sparkSession)
    place = ["day", "x_km", "y_km"]
    ends = nodes.groupBy(*place).agg(F.max("k").alias("last"))
    before = nodes.join(ends, place).filter("k < last").groupBy(*place).agg(F.max("k").alias("second"))
    places = stage.keep("places", ends.join(before, place, "left"))
    rows = places.select("day", F.col("last").alias("k"), F.col("last").alias("route"), F.lit(0).cast("bigint").alias("load"), "x_km", "y_km")
    laid = stage.keep("blocks", routing.in_blocks(rows))
    apart = routing.best_partners(laid, stage.keep("boxes", routing.boxes(laid)), stage, "partners", digits=6).select("day", F.col("route").alias("last"), "gain", F.col("mate").alias("other"))
    here = F.when(F.col("k") == F.col("last"), F.col("second")).otherwise(F.col("last"))
    own = F.when(here.isNotNull(), F.struct(F.round(2 * F.sqrt(F.col("x_km") * F.col("x_km") + F.col("y_km") * F.col("y_km")), 6).alias("saving_km"), here.alias("mate")))
    away = F.when(F.col("gain").isNotNull(), F.struct(F.col("gain").alias("saving_km"), F.col("other").alias("mate")))
    offered = nodes.join(places, place).join(apart, ["day", "last"], "left").withColumn("best", F.greatest(own, away)).filter("best.saving_km > 0")
    names = nodes.select("day", F.col("k").alias("mate"), F.col("invoice").alias("partner"))
    return offered.select("day", "invoice", "best.*").join(names, ["day", "mate"]).select("day", "invoice", "partner", "saving_km")


def route_km(routes: DataFrame, places: DataFrame) -> DataFrame:
    """Length of each route, depot to depot; a route holds at most one vehicle load of drops."""
    stops = routes.join(places.select("invoice", "x_km", "y_km"), "invoice")
    key = ["day", "route"]
    order = Window.partitionBy(*key).orderBy("seq")
    legs = stops.select(
        *key, "x_km", "y_km",
        F.lag("x_km", 1, 0.0).over(order).alias("px"), F.lag("y_km", 1, 0.0).over(order).alias("py"),
        F.lead("seq").over(order).isNull().alias("last"),
    )
    km = F.hypot(F.col("x_km") - F.col("px"), F.col("y_km") - F.col("py"))
    home = F.when(F.col("last"), F.hypot("x_km", "y_km")).otherwise(0.0)
    return legs.groupBy(*key).agg(F.count(F.lit(1)).alias("stops"), F.sum(km + home).alias("km"))


def per_day(route_lengths: DataFrame, shipments_df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Daily drops, cartons, distance and vehicles, with the out-and-back upper and the load-based lower bound."""
    away = F.hypot("x_km", "y_km")
    loads = shipments_df.groupBy("day").agg(
        F.count(F.lit(1)).alias("drops"),
        F.sum("packed").alias("cartons"),
        F.sum("full_trips").alias("direct_trips"),
        F.sum("direct_km").alias("_direct_km"),
        F.sum(2.0 * away * F.col("cartons") / p.vehicle_cartons).alias("lo_km"),
        F.sum(2.0 * away * (F.col("full_trips") + F.col("is_node").cast("int"))).alias("hi_km"),
    )
    routed = route_lengths.groupBy("day").agg(F.sum("km").alias("_km"), F.count(F.lit(1)).alias("_routes"))
    return loads.join(routed, "day", "left").select(
        "day", "drops", "cartons", "direct_trips",
        (F.coalesce("_km", F.lit(0.0)) + F.col("_direct_km")).alias("km"),
        (F.coalesce("_routes", F.lit(0)) + F.col("direct_trips")).alias("vehicles"),
        "lo_km", "hi_km",
    )


def routed_drops(route_lengths: DataFrame, shipments_df: DataFrame) -> DataFrame:
    """Drops counted from the routes themselves, plus orders that only fill whole vehicles."""
    in_routes = route_lengths.agg(F.coalesce(F.sum("stops"), F.lit(0)).alias("n")).scalar()
    return shipments_df.agg((F.count_if(~F.col("is_node")) + in_routes).alias("routed_drops"))


def method_record(daily: DataFrame, plan: str = "km", other: str = "hi_km") -> DataFrame:
    """Days on which ``plan`` is shorter, equal or longer than ``other``, and the total difference in percent."""
    gap: Column = F.col(plan) - F.col(other)
    return daily.agg(
        F.count_if(gap < -TIE_KM).alias("wins"),
        F.count_if(F.abs(gap) <= TIE_KM).alias("ties"),
        F.count_if(gap > TIE_KM).alias("losses"),
        F.coalesce(F.try_divide(100.0 * F.sum(gap), F.sum(other)), F.lit(0.0)).alias("delta_pct"),
    )


def km_bounds(daily: DataFrame) -> DataFrame:
    """The day's distance between its radial lower bound and one trip per drop; ``inside`` for every valid plan."""
    inside = (F.col("km") >= F.col("lo_km") - TIE_KM) & (F.col("km") <= F.col("hi_km") + TIE_KM)
    return daily.select("day", "lo_km", "km", "hi_km", inside.alias("inside"))
