"""Savings between the drops of a day of any size: the best partner of each and the merges that make routes.

Pairs of drops are never listed. A day's drops lie in blocks of near bearing and distance, each with one summary row: its
box and its largest distance from the depot. No saving between two blocks is larger than the two distances less the gap between
the boxes, so a block first looks at itself and then opens only blocks whose bound reaches what its drops have already; opened
blocks are compared as arrays, and each row keeps its one best partner.

Merging the best pairs in turn has the same result as merging, in any order, pairs that are best for both of their routes:
such a pair cannot be ruled out by any pair before it, as a pair that is infeasible once stays so. So a round merges inside blocks
of near bearing all pairs that no pair with another block can come before. It reads and writes routes as rows; done ones leave.
"""

from __future__ import annotations

import heapq
import itertools
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.operators.prefix import largest_group, lay_out, rank_in_group
from orderloom.sources.stage import StageTables

BLOCK_DROPS = 1024
BLOCK_ENDS = 8192  # open ends that one task merges; its tables have as many rows
_ROWS = 256  # ends whose partners are looked for at once
_BEST = "day date, route bigint, gain double, i bigint, j bigint, mate bigint"


def in_blocks(places: DataFrame, size: int = BLOCK_DROPS) -> DataFrame:
    """``places`` (day, k, x_km, y_km, ..) with their block: the day's places by bearing, ``size`` in turn."""
    bearing, away = F.round(F.atan2("y_km", "x_km"), 2), F.hypot("x_km", "y_km")
    placed = rank_in_group(places, ["day"], [bearing, away, F.col("k")], largest_group(places, ["day"]), "_place")
    return placed.withColumn("block", F.floor((F.col("_place") - 1) / size).cast("int")).drop("_place")


def _best_of(capacity: int | None, digits: int | None, table: pa.Table) -> pa.Table:
    """Best feasible partner of every route with rows in ``table``: two blocks (b and c), or one with itself."""
    kept = {n: table.column(n).to_numpy() for n in ("k", "route", "load", "x_km", "y_km", "side")}
    order = np.argsort(-kept["k"], kind="stable")  # of equal savings the larger number comes first
    kept = {n: v[order] for n, v in kept.items()}
    left = np.flatnonzero(kept["side"] == 0)
    right = np.flatnonzero(kept["side"] == 1) if (kept["side"] == 1).any() else left
    away = np.sqrt(kept["x_km"] ** 2 + kept["y_km"] ** 2)
    k, route, load, x, y = (kept[n] for n in ("k", "route", "load", "x_km", "y_km"))
    apart = np.sqrt((x[left][:, None] - x[right]) ** 2 + (y[left][:, None] - y[right]) ** 2)
    gain = away[left][:, None] + away[right] - apart
    if digits is not None:
        gain = np.round(gain, digits)
    barred = (route[left][:, None] == route[right]) | (gain <= 0)
    if capacity is not None:
        barred |= load[left][:, None] + load[right] > capacity
    gain[barred] = -np.inf
    found = []
    for matrix, own, other in ((gain, left, right), (gain.T, right, left)):
        at = matrix.argmax(1) if matrix.shape[1] else np.zeros(0, np.int64)
        best = matrix[np.arange(len(own)), at]
        real = np.flatnonzero(best > -np.inf)
        a, b = own[real], other[at[real]]
        found.append((route[a], best[real], np.minimum(k[a], k[b]), np.maximum(k[a], k[b]), route[b]))
        if left is right:
            break
    own, best, i, j, mate = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((j, i, best, own))
    last = order[np.flatnonzero(np.append(own[order][1:] != own[order][:-1], True))] if len(order) else order
    day = pa.array([table.column("day")[0].as_py()] * len(last), pa.date32())
    return pa.table([day, *(pa.array(c[last]) for c in (own, best, i, j, mate))], names=["day", "route", "gain", "i", "j", "mate"])


def boxes(places: DataFrame) -> DataFrame:
    """One row per block: its box and its largest distance from the depot. They hold for any part of its drops."""
    return places.groupBy("day", "block").agg(
        F.min("x_km").alias("x0"), F.max("x_km").alias("x1"), F.min("y_km").alias("y0"), F.max("y_km").alias("y1"), F.max(F.hypot("x_km", "y_km")).alias("far"),
    )


def best_partners(
    rows: DataFrame, blocks: DataFrame | None, stage: StageTables, name: str, capacity: int | None = None, digits: int | None = None,
) -> DataFrame:
    """Per route its best pair (gain, i, j) and the other route ``mate``; ``rows`` are open ends (day, block, k, route, load, x_km, y_km).

    Pairs are ordered by gain, then by their smaller and their larger number, later ones better. With ``capacity`` the loads of both routes must
    fit it, with ``digits`` gains are rounded. Routes without a pair of positive gain have no row. Without ``blocks`` every day is one block.
    """
    def run(table: pa.Table) -> pa.Table:
        return _best_of(capacity, digits, table)

    ends = ["day", "k", "route", "load", "x_km", "y_km"]
    alone = rows.withColumn("side", F.lit(0)).select("block", "side", *ends).groupBy("day", "block").applyInArrow(run, _BEST)
    best = F.max(F.struct("gain", "i", "j", "mate")).alias("best")
    if blocks is None:
        return alone.groupBy("day", "route").agg(best).select("day", "route", "best.*")
    alone = stage.keep(f"{name}-alone", alone)
    # what every route of a block has already; a route without a pair opens all blocks of positive bound
    held = rows.join(alone.groupBy("day", "route").agg(F.max("gain").alias("gain")), ["day", "route"], "left").groupBy("day", "block").agg(
        F.min(F.coalesce("gain", F.lit(0.0))).alias("least"), F.min("load").alias("light"),
    ).join(blocks, ["day", "block"])
    other = held.select("day", *[F.col(c).alias(f"o_{c}") for c in held.columns if c != "day"])
    gap = lambda a0, a1, b0, b1: F.greatest(F.lit(0.0), F.col(b0) - F.col(a1), F.col(a0) - F.col(b1))
    bound = F.col("far") + F.col("o_far") - F.hypot(gap("x0", "x1", "o_x0", "o_x1"), gap("y0", "y1", "o_y0", "o_y1"))
    opened = held.join(other, "day").filter((F.col("block") < F.col("o_block")) & (bound + 1e-6 >= F.least("least", "o_least")) & (bound > 0))
    if capacity is not None:
        opened = opened.filter(F.col("light") + F.col("o_light") <= capacity)
    # one row per two blocks that may hold a better pair
    pairs = opened.select("day", "block", "o_block", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).withColumn(
        "own", F.when(F.col("side") == 0, F.col("block")).otherwise(F.col("o_block")),
    )
    dealt = rows.withColumnRenamed("block", "own").join(pairs, ["day", "own"]).select("block", "o_block", "side", *ends)
    across = dealt.groupBy("day", "block", "o_block").applyInArrow(run, _BEST)
    return alone.union(across).groupBy("day", "route").agg(best).select("day", "route", "best.*")


def _merge_block(capacity: int, table: pa.Table) -> pa.Table:
    """Merges inside one block of route ends, best pair first, as far as no pair with an end outside can come before.

    The pairs are never listed: each end keeps its best partner. As ends only close and loads only grow, what it keeps is never
    less than what it has, so the largest kept pair is looked at first and worked out anew if it is no longer open.
    A pair outside saves no more than one with a drop as far away as any of the day in the nearest bearing of another block.
    A route whose best pair may lie outside waits, and so do those whose best partner waits.
    """
    got = {n: table.column(n).to_numpy(zero_copy_only=False) for n in ("route", "load", "k", "x_km", "y_km", "bearing", "split")}
    got = {n: v[np.argsort(-got["k"], kind="stable")] for n, v in got.items()}  # of equal savings the larger number comes first
    day, light, reach = (table.column(c)[0].as_py() for c in ("day", "light", "reach"))
    below, above = (table.column(c)[0].as_py() for c in ("below", "above"))
    names, own = np.unique(got["route"], return_inverse=True)
    k, x, y, heavy = got["k"], got["x_km"], got["y_km"], got["load"].copy()
    away = np.sqrt(x * x + y * y)
    outside = np.full(len(k), -np.inf)
    if below is not None:
        angle = np.clip(np.minimum(got["bearing"] - below, above - got["bearing"]), 0.0, np.pi)
        outside = away + reach - np.sqrt(np.maximum(away**2 + reach**2 - 2 * away * reach * np.cos(angle), 0.0)) + 1e-6
    load, bound, waits = np.zeros(len(names), np.int64), np.full(len(names), -np.inf), np.zeros(len(names), bool)
    load[own] = heavy
    np.maximum.at(bound, own, outside)
    np.logical_or.at(waits, own, got["split"])
    ends = [[] for _ in names]  # of a route, as places in the block's arrays, that of smaller number first
    for e in range(len(k) - 1, -1, -1):
        ends[own[e]].append(e)
    chains = [[(r, False)] for r in range(len(names))]
    alive = np.ones(len(k), bool)
    near = np.arange(len(k))  # the open ends in order of falling number

    def gains(some: np.ndarray) -> np.ndarray:
        apart = np.sqrt((x[some][:, None] - x[near]) ** 2 + (y[some][:, None] - y[near]) ** 2)
        gain = away[some][:, None] + away[near] - apart
        barred = ~alive[near] | (own[some][:, None] == own[near]) | (gain <= 0) | (heavy[some][:, None] + heavy[near] > capacity)
        gain[barred] = -np.inf
        return gain

    def entries(some: np.ndarray) -> list[tuple]:
        gain = gains(some)
        at = gain.argmax(1)
        best, mate = gain[np.arange(len(some)), at], near[at]
        low, high = np.minimum(k[some], k[mate]), np.maximum(k[some], k[mate])
        return [t for t in zip((-best).tolist(), (-low).tolist(), (-high).tolist(), some.tolist(), mate.tolist()) if t[0] < 0]

    heap = [t for at in range(0, len(k), _ROWS) for t in entries(np.arange(at, min(at + _ROWS, len(k))))]
    heapq.heapify(heap)
    closed = 0
    while heap:
        gain, _, _, a, b = heapq.heappop(heap)
        u, v = own[a], own[b]
        if not alive[a] or waits[u]:
            continue
        if alive[b] and u != v and load[u] + load[v] <= capacity:
            if waits[v] or -gain <= max(bound[u], bound[v]):
                waits[u] = waits[v] = True
                continue
            first = a if len(ends[u]) == 1 else ends[u][ends[u][0] == a]
            last = b if len(ends[v]) == 1 else ends[v][ends[v][0] == b]
            # the ends that meet come to stand in the middle
            ours = chains[u] if ends[u][-1] == a else [(r, not f) for r, f in reversed(chains[u])]
            theirs = chains[v] if ends[v][0] == b else [(r, not f) for r, f in reversed(chains[v])]
            chains[u], chains[v], ends[u], ends[v] = ours + theirs, [], [first, last], []
            for e, kept in ((a, first), (b, last)):
                if e != kept:
                    alive[e] = False
                    closed += 1
            own[[first, last]] = u
            load[u] += load[v]
            heavy[[first, last]] = load[u]
            bound[u] = max(outside[first], outside[last])
            if 2 * closed > len(near):
                near, closed = near[alive[near]], 0
        if alive[a]:
            for t in entries(np.array([a])):
                heapq.heappush(heap, t)
    out = []
    for u, chain in enumerate(chains):
        # a route that neither waits nor has a pair to hope for outside is done
        rest = bool(waits[u] or bound[u] > 0) and int(load[u]) + light <= capacity
        out += [(int(names[r]), int(names[u]), seq, flip, rest) for seq, (r, flip) in enumerate(chain)]
    columns = list(zip(*out, strict=True))
    types = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_())
    return pa.table([pa.array([day] * len(out), pa.date32()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["day", "route", "into", "seq", "flip", "open"])


def _in_turns(ends: DataFrame, size: int, largest: int) -> DataFrame:
    """``ends`` with their block, a run of ``size`` bearings, the nearest bearings below and above of other blocks, and what holds for the day."""
    bearing = F.atan2("y_km", "x_km")
    placed = rank_in_group(ends.withColumn("bearing", bearing), ["day"], [F.col("bearing"), F.col("k")], largest, "_place")
    placed = placed.withColumn("block", F.floor((F.col("_place") - 1) / size).cast("int")).drop("_place")
    turn, day = Window.partitionBy("day").orderBy("block"), Window.partitionBy("day")
    # one row per block; beyond the first and the last the circle goes on
    wedges = placed.groupBy("day", "block").agg(
        F.min("bearing").alias("t0"), F.max("bearing").alias("t1"), F.max(F.hypot("x_km", "y_km")).alias("far"), F.min("load").alias("light"),
    ).select(
        "day", "block", F.max("far").over(day).alias("reach"), F.min("light").over(day).alias("light"),
        F.when(F.count(F.lit(1)).over(day) > 1, F.coalesce(F.lag("t1").over(turn), F.max("t1").over(day) - 2 * math.pi)).alias("below"),
        F.when(F.count(F.lit(1)).over(day) > 1, F.coalesce(F.lead("t0").over(turn), F.min("t0").over(day) + 2 * math.pi)).alias("above"),
    )
    cut = placed.groupBy("day", "route").agg((F.min("block") < F.max("block")).alias("split"))
    return placed.join(cut.hint("merge"), ["day", "route"]).join(wedges.hint("merge"), ["day", "block"])


def merge_in_rounds(nodes: DataFrame, capacity: int, size: int = BLOCK_ENDS) -> DataFrame:
    """Routes of the days in ``nodes`` (day, k, x_km, y_km, load): rows (day, route, seq, k), a route named by its smallest number.

    A route goes from its end of smaller number to the other, in every round; it holds a vehicle load of drops at most and is one row with
    its path. Every round merges inside blocks of ``size`` open ends and is written to the shared folder; routes that are done leave.
    A round that leaves most of the routes open doubles the blocks, so a day ends as one block at the latest. No round
    broadcasts: its joins are by day, so rounds send the driver nothing but two counts.
    """
    stage = StageTables(nodes.sparkSession)
    at = F.struct("k", "x_km", "y_km")
    start = nodes.select("day", F.col("k").alias("route"), F.array("k").alias("path"), "load", at.alias("a"), at.alias("b"), F.lit(True).alias("open"))
    routes = stage.keep("routes", start)
    done, left = [], routes.count()

    def merge(table: pa.Table) -> pa.Table:
        return _merge_block(capacity, table)

    for turn in itertools.count():
        going = routes.filter("open")
        ends = going.select("day", "route", "load", F.inline(F.array_distinct(F.array("a", "b"))))
        dealt = _in_turns(ends, size, largest_group(ends, ["day"]))
        merged = dealt.groupBy("day", "block").applyInArrow(merge, "day date, route bigint, into bigint, seq int, flip boolean, open boolean")
        # a cut route has one row from each block
        merged = merged.groupBy("day", "route").agg(F.max(F.struct("into", "seq", "flip", "open")).alias("m")).select("day", "route", "m.*")
        part = F.struct(
            "seq", "load", F.when(F.col("flip"), F.reverse("path")).otherwise(F.col("path")).alias("path"),
            F.when(F.col("flip"), F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("flip"), F.col("a")).otherwise(F.col("b")).alias("b"),
        )
        joined = going.drop("open").join(merged.hint("merge"), ["day", "route"]).groupBy("day", F.col("into").alias("route")).agg(
            F.array_sort(F.collect_list(part)).alias("parts"), F.sum("load").alias("load"), F.bool_and("open").alias("open"),
        )
        a, b, path = F.col("parts")[0]["a"], F.element_at("parts", -1)["b"], F.flatten("parts.path")
        swap = a["k"] > b["k"]
        routes = stage.keep(f"routes-{turn}", joined.select(
            "day", "route", F.when(swap, F.reverse(path)).otherwise(path).alias("path"), "load",
            F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b"), "open",
        ))
        done.append(routes.filter("NOT open"))
        before, left = left, routes.filter("open").count()
        if not left:
            break
        if 2 * left > before:
            size *= 2
    every = reduce(DataFrame.union, done)
    return every.select("day", F.array_min("path").alias("route"), F.posexplode("path").alias("seq", "k"))


def sweep(nodes: DataFrame, capacity: int) -> DataFrame:
    """A second plan: a day's drops by bearing, each vehicle filled until the next drop does not fit. Rows (day, route, seq, k).

    The state is the running load, which starts anew with each vehicle. A piece of a day (what one range holds of it) is first a table
    from every load it may begin with to the load it ends with and the vehicles it adds; a day's tables, one per range,
    are composed in order, and then every piece numbers its drops from its own beginning.
    """
    laid = lay_out(nodes.select("day", "k", "load", F.round(F.atan2("y_km", "x_km"), 9).alias("bearing")), [F.col("day"), F.col("bearing"), F.col("k")])
    piece = ["day", "_gp_part"]

    def table_of(rows: pa.Table) -> pa.Table:
        load, added = np.arange(capacity + 1), np.zeros(capacity + 1, np.int64)
        for own in rows.column("load").to_numpy()[np.argsort(rows.column("_gp_pos").to_numpy())].tolist():
            full = load + own > capacity
            added += full
            load = np.where(full, own, load + own)
        first = [rows.column(c).slice(0, 1) for c in piece]
        return pa.table([*first, pa.array([load.tolist()]), pa.array([added.tolist()])], names=[*piece, "load", "added"])

    def begin_of(rows: pa.Table) -> pa.Table:
        out, load, route = [], 0, 0
        for r in sorted(rows.to_pylist(), key=lambda r: r["_gp_part"]):
            out.append({"day": r["day"], "_gp_part": r["_gp_part"], "load0": load, "route0": route})
            load, route = r["load"][load], route + r["added"][load]
        return pa.Table.from_pylist(out, pa.schema([("day", pa.date32()), ("_gp_part", pa.int64()), ("load0", pa.int64()), ("route0", pa.int64())]))

    def number(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("_gp_pos").to_numpy())
        load, route = rows.column("load0")[0].as_py(), rows.column("route0")[0].as_py()
        found = []
        for own in rows.column("load").to_numpy()[order].tolist():
            if load + own > capacity:
                load, route = 0, route + 1
            load += own
            found.append(route)
        return pa.table([rows.column("day").take(pa.array(order)), pa.array(found, pa.int64()), rows.column("k").take(pa.array(order)),
                         rows.column("bearing").take(pa.array(order))], names=["day", "route", "k", "bearing"])

    # one row per range and day
    tables = laid.groupBy(*piece).applyInArrow(table_of, "day date, _gp_part bigint, load array<bigint>, added array<bigint>")
    begins = tables.groupBy("day").applyInArrow(begin_of, "day date, _gp_part bigint, load0 bigint, route0 bigint")
    numbered = laid.join(begins, piece).groupBy(*piece).applyInArrow(number, "day date, route bigint, k bigint, bearing double")
    order = Window.partitionBy("day", "route").orderBy("bearing", "k")  # a vehicle load of drops at most
    return numbered.select("day", "route", (F.row_number().over(order) - 1).alias("seq"), "k")
