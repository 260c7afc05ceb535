"""Exact quantiles by counting passes: no row is sorted but those of the last, narrow bins.

A pass counts the rows of fixed bins between the smallest and the largest value; the bin that holds a wanted
rank becomes the next interval. Each pass reads one narrow column and shuffles at most ``BINS`` counts a task.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.operators.prefix import ONE_TASK_ROWS
from orderloom.session import shared_folder

BINS = 1024


class Interval(NamedTuple):
    """Values from ``low`` to ``high``: ``rows`` of them, with ``before`` rows below."""

    low: float
    high: float
    before: int
    rows: int


def _bin(value: Column, i: Interval) -> Column:
    """The value's bin; it never falls as the value grows, the ends lie in the first and the last bin."""
    if i.low == i.high:
        return F.lit(0)
    half = 0.5 if math.isinf(i.high - i.low) else 1.0  # the width may pass the largest double
    width = i.high * half - i.low * half
    place = F.floor((value * half - i.low * half) / F.lit(width) * BINS)
    return F.least(place, F.lit(BINS - 1)).cast("int")


def _inside(value: Column, intervals: list[Interval]) -> Column:
    out = F.lit(False)
    for i in intervals:
        out = out | value.between(i.low, i.high)
    return out


def _narrowed(values: DataFrame, intervals: list[Interval], ranks: list[int]) -> list[Interval]:
    """One counting pass over all intervals: the bins that hold a wanted rank, by their own smallest and largest value."""
    value, number, place = F.col("value"), F.lit(None).cast("int"), F.lit(None).cast("int")
    for at, i in enumerate(intervals):
        number = F.when(value.between(i.low, i.high), at).otherwise(number)
        place = F.when(value.between(i.low, i.high), _bin(value, i)).otherwise(place)
    counted = (
        values.filter(_inside(value, intervals))
        .groupBy(number.alias("i"), place.alias("b"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    )
    # at most BINS rows an interval, and at most two intervals a quantile
    out, done = [], {at: i.before for at, i in enumerate(intervals)}
    for row in counted.orderBy("i", "b").collect():
        held = Interval(row["low"], row["high"], done[row["i"]], row["n"])
        done[row["i"]] += row["n"]
        if any(held.before < r <= held.before + held.rows for r in ranks):
            out.append(held)
    return out


def values_at(values: DataFrame, ranks: list[int], intervals: list[Interval], one_task: int = ONE_TASK_ROWS) -> dict[int, float]:
    """The value of each wanted rank (from 1) of the column ``value``; the ranks lie in ``intervals``."""
    open_ones = [i for i in intervals if i.low < i.high]
    settled = [i for i in intervals if i.low == i.high]
    while sum(i.rows for i in open_ones) > one_task:
        found = _narrowed(values, open_ones, ranks)
        settled += [i for i in found if i.low == i.high]
        open_ones = [i for i in found if i.low < i.high]
    out = {r: i.low for i in settled for r in ranks if i.before < r <= i.before + i.rows}
    if open_ones:
        # equal values are one row; all together at most ``one_task``
        same = values.filter(_inside(F.col("value"), open_ones)).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
        left = [r for r in ranks if r not in out]
        base = F.lit(0)
        below = 0
        for i in sorted(open_ones):
            base = F.when(F.col("value") >= i.low, i.before - below).otherwise(base)
            below += i.rows
        last = (upto + base).alias("last")
        wanted = same.select("value", "n", last).withColumn(
            "r", F.explode(F.filter(F.array(*[F.lit(r).cast("long") for r in left]), lambda r: (r <= F.col("last")) & (r > F.col("last") - F.col("n"))))
        )
        out |= {row["r"]: row["value"] for row in wanted.select("r", "value").collect()}
    return out


def quantiles(df: DataFrame, column: str, at: dict[str, float], one_task: int = ONE_TASK_ROWS) -> DataFrame:
    """Exact quantiles with linear interpolation between neighbours, as ``percentile`` gives; one row, a column each.

    Nulls and NaN take no part; without other values every quantile is 0. Equal values, repeated rows and infinite
    values need no special care of the caller: infinite ones are counted at the ends.
    """
    shared_folder(df.sparkSession)
    value = F.col(column).cast("double")
    # one narrow column, written once; it is not shuffled
    values = df.select(value.alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value")).checkpoint()
    infinite = F.abs("value") == float("inf")
    ends = values.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("value") == float("-inf")).alias("least"),
        F.count_if(F.col("value") == float("inf")).alias("most"),
        F.min(F.when(~infinite, F.col("value"))).alias("low"),
        F.max(F.when(~infinite, F.col("value"))).alias("high"),
    ).first()
    places = {name: q * (ends["n"] - 1) for name, q in at.items()}
    found: dict[int, float] = {}
    if ends["n"]:
        ranks = sorted({min(r, ends["n"]) for p in places.values() for r in (math.floor(p) + 1, math.floor(p) + 2)})
        whole = [Interval(float("-inf"), float("-inf"), 0, ends["least"])]
        finite = ends["n"] - ends["least"] - ends["most"]
        if finite:
            whole.append(Interval(ends["low"], ends["high"], ends["least"], finite))
        whole.append(Interval(float("inf"), float("inf"), ends["least"] + finite, ends["most"]))
        found = values_at(values, ranks, whole, one_task)

    def quantile(place: float) -> float:
        low, weight = math.floor(place), place - math.floor(place)
        lower = found[low + 1]
        return lower * (1.0 - weight) + found[low + 2] * weight if weight else lower

    row = tuple(quantile(places[name]) if found else 0.0 for name in at)
    return df.sparkSession.createDataFrame([row], ", ".join(f"`{name}` double" for name in at))
