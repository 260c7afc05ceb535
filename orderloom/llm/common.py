"""Helpers shared by the text operators: table access, Arrow batches and connected components."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.sources.stage import StageTables

# A side of a join is broadcast only after its rows were counted and are at most this many narrow rows.
BROADCAST_ROWS = 500_000
TEXT_BYTES = 4 << 20  # of text that a task has in Python at a time, and one longer text at most


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; -1 where the id is null."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % divisor, F.lit(-1))


def map_arrow(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: int | None = None) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of ``df``, in parts of some megabytes of column ``text``; batches without rows are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in [batch] if text is None else slices(batch, text, TEXT_BYTES):
                out = fn(part) if part.num_rows else None
                if out is not None and out.num_rows:
                    yield out
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system; a worker process lives on between tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def kept_in_process(name: str) -> dict:
    """A dict that outlives tasks of a worker process, also where functions travel to it by value and modules are not imported."""
    home = sys.modules.setdefault("_orderloom_process", types.ModuleType("_orderloom_process"))
    return home.__dict__.setdefault(name, {})


def slices(batch: pa.RecordBatch, column: int, most_bytes: int, most_rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of whole rows whose ``column`` (text or bytes) holds about ``most_bytes`` at most; a larger row is a part alone."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = min(at + most_rows, max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def small_side(df: DataFrame) -> DataFrame:
    """``df`` (already stored) with a broadcast hint when its counted rows are few; the join's rows are the same."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def components(links: DataFrame, stage: StageTables, name: str) -> DataFrame:
    """Connected components of ``links(a, b)``: one row (node, component_id) per node, labelled by its smallest node.

    Alternating star contraction: every node hands its neighbours the smallest node it knows, first to
    the larger ones, then to the smaller ones. Minima are pre-aggregated before they are shuffled. They are joined
    back by broadcast while the counted links are few, else by plain equi-joins that adaptive execution can split. Every
    round is written to the shared folder. It ends when a round leaves the set of links as it was.
    """
    edges = stage.keep(
        f"{name}_0",
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
    )
    state, turn = _fingerprint(edges), 0
    while state[0]:
        turn += 1
        # a node has one minimum, so there are at most as many minima as ends of links
        near = F.broadcast if 2 * state[0] <= BROADCAST_ROWS else (lambda df: df)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(near(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near(low), "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        )).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = stage.keep(f"{name}_{turn}", small)
        now = _fingerprint(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(
        roots.select("node", F.col("node").alias("component_id"))
    )


def _fingerprint(edges: DataFrame) -> tuple:
    """The number of links and one number that stands for the whole set of them."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
