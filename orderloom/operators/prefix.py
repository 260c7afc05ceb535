"""Ranks and running totals over inputs of any size.

``Window.orderBy`` without a partition sends every row to one task. Here the rows are laid out in
key ranges, each range is numbered where it lies, and the ranges are linked by offsets taken from
one summary row per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.session import shared_folder

# Groups or tables up to this many rows may be ordered inside one task.
ONE_TASK_ROWS = 100_000
_POSITION_BITS = 33


def lay_out(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range-partition and sort by ``order`` (which must end in a unique key); adds ``_gp_part`` and ``_gp_pos``.

    Later passes must see one and the same layout, also after an executor is lost, so the layout is
    written to the checkpoint folder.
    """
    shared_folder(df.sparkSession)
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = laid.withColumn("_gp_at", F.monotonically_increasing_id())
    return (
        placed.withColumn("_gp_part", F.shiftright("_gp_at", _POSITION_BITS))
        .withColumn("_gp_pos", F.col("_gp_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop("_gp_at")
        .checkpoint()
    )


def global_prefix(df: DataFrame, order: Sequence[Column], sums: Sequence[str] = ()) -> DataFrame:
    """Adds ``rank`` (1-based), ``n_rows`` and, per column in ``sums``, ``cum_<column>``."""
    laid = lay_out(df, order)
    totals = laid.groupBy("_gp_part").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{c}") for c in sums]
    )
    # one row per range: bounded by the number of partitions
    before = Window.orderBy("_gp_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_gp_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "_gp_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rank0"),
        F.sum("_n").over(everything).alias("n_rows"),
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
    )
    joined = laid.join(F.broadcast(offsets), "_gp_part")
    local = Window.partitionBy("_gp_part").orderBy("_gp_pos").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(
        *df.columns,
        (F.col("_rank0") + F.col("_gp_pos") + 1).alias("rank"),
        "n_rows",
        *[(F.col(f"_o_{c}") + F.sum(c).over(local)).alias(f"cum_{c}") for c in sums],
    )


def rank_rows(df: DataFrame, order: Sequence[Column], bound: int, name: str = "rank") -> DataFrame:
    """1-based rank of a table that holds at most ``bound`` rows by construction."""
    if bound <= ONE_TASK_ROWS:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    ranked = global_prefix(df, order)
    return ranked.select(*df.columns, F.col("rank").alias(name))


def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    """Rows in the largest group; one number comes back."""
    sizes = df.groupBy(*group).count()
    return sizes.agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


def rank_in_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], largest: int, name: str = "rank"
) -> DataFrame:
    """1-based rank inside each group; a plain window while every group fits one task.

    Beyond that the groups are cut across ranges: a row's place in its range plus what earlier ranges hold of
    its group. Rows are joined by range and group, so a large group stays spread over its ranges.
    """
    if largest <= ONE_TASK_ROWS:
        window = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window).cast("bigint"))
    laid = lay_out(df, [*[F.col(g) for g in group], *order])
    piece = ["_gp_part", *group]
    # one row per (range, group): at most ranges + groups rows
    pieces = laid.groupBy(*piece).agg(F.count(F.lit(1)).alias("_n"), F.min("_gp_pos").alias("_at"))
    prior = Window.partitionBy(*group).orderBy("_gp_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_base", F.coalesce(F.sum("_n").over(prior), F.lit(0)) - F.col("_at"))
    joined = laid.join(pieces.select(*piece, "_base"), piece)
    return joined.select(*df.columns, (F.col("_gp_pos") + F.col("_base") + 1).alias(name))


def queue_scan(
    df: DataFrame, segment: Sequence[str], order: Sequence[Column], arrive: str, service: str, largest: int,
    name: str = "finish",
) -> DataFrame:
    """First-in-first-out finish times inside each segment, starting idle.

    With C the running service time, finish = C + max over the jobs so far of (arrival - C before it).
    Both parts are prefix scans, so a segment cut across ranges needs only one carried pair per piece.
    """
    if largest <= ONE_TASK_ROWS:
        window = Window.partitionBy(*segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        worked = df.withColumn("_c", F.sum(service).over(window))
        slack = F.col(arrive) - (F.col("_c") - F.col(service))
        return worked.withColumn(name, F.col("_c") + F.max(slack).over(window)).drop("_c")

    laid = lay_out(df, [*[F.col(s) for s in segment], *order])
    piece = ["_gp_part", *segment]
    local = Window.partitionBy(*piece).orderBy("_gp_pos").rowsBetween(Window.unboundedPreceding, 0)
    worked = laid.withColumn("_c", F.sum(service).over(local))
    worked = worked.withColumn("_m", F.max(F.col(arrive) - (F.col("_c") - F.col(service))).over(local))
    # one row per (range, segment): at most ranges + segments rows
    pieces = worked.groupBy(*piece).agg(F.sum(service).alias("_s"), F.max("_m").alias("_top"))
    prior = Window.partitionBy(*segment).orderBy("_gp_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_o", F.coalesce(F.sum("_s").over(prior), F.lit(0.0)))
    pieces = pieces.withColumn("_in", F.max(F.col("_top") - F.col("_o")).over(prior))
    carried = worked.join(pieces.select(*piece, "_o", "_in"), piece)
    best = F.greatest(F.col("_in"), F.col("_m") - F.col("_o"))
    return carried.select(*df.columns, (F.col("_o") + F.col("_c") + best).alias(name))
