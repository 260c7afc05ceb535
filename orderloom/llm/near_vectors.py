"""Near-duplicate embeddings by tiled comparison in the order of principal components.

Vectors are rotated so that leading coordinates carry most; a rotation keeps every cosine. A tile pair sums the leading
coordinates of all its pairs first. What the others can still add is at most the product of the two suffix norms, so
pairs whose sum and bound stay below the threshold stop there, and only the rest is carried on, block of coordinates by
block. Blocks of rows are cut along the first coordinate; two blocks farther apart on it than the threshold allows
never meet. Copies are one row with a count, links are counted where they are found and leave a tile pair only as a
spanning forest.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import components, map_arrow
from orderloom.llm.vectors import as_matrix, by_length, scaled, valid_vectors
from orderloom.sources.stage import StageTables

THRESHOLD = 0.9
SAMPLE = 20_000  # vectors the rotation is fitted on, at most; any rotation gives the same links
BLOCK, TILE = 8192, 1024
LEADING = 0.25  # share of the coordinates summed first
_SLACK = 1e-5  # of the single-precision sums


def rotation(unique: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Principal directions of a bounded sample, strongest first; the identity for an empty table."""
    n = unique.count()
    key = F.pmod(F.xxhash64("v"), F.lit(1 << 30))
    drawn = unique.filter(key < int(min(1.0, sample / max(1, n)) * (1 << 30))).select("v").collect()
    if not drawn:
        width = unique.select(F.octet_length("v").alias("n")).first()
        return np.eye(width["n"] // 8 if width else 1)
    x = unit(np.stack([np.frombuffer(r["v"], "<f8") for r in drawn]))
    _, directions = np.linalg.eigh(x.T @ x)
    return np.ascontiguousarray(directions[:, ::-1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Side:
    """Rows of one block, ready to be compared: rotated, with the suffix norm behind the leading coordinates."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, v: np.ndarray, turn: np.ndarray):
        v = scaled(v)  # a cosine stays what it is
        y = unit(v) @ turn
        order = np.argsort(y[:, 0], kind="stable")
        self.ids, self.copies, self.v, self.y = ids[order], copies[order], v[order], y[order]
        lead = max(1, math.ceil(LEADING * y.shape[1]))
        self.steps = [*range(lead, y.shape[1], lead), y.shape[1]]
        suffix = np.sqrt(np.maximum(0, np.cumsum((self.y**2)[:, ::-1], 1)[:, ::-1]))
        self.after = {s: suffix[:, s] if s < y.shape[1] else np.zeros(len(y)) for s in self.steps}
        self.head = np.concatenate([self.y[:, :lead], self.after[lead][:, None]], 1).astype(np.float32)


def linked(a: Side, i: slice, b: Side, j: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of the pairs of a tile pair whose cosine reaches the threshold."""
    bound = a.head[i] @ b.head[j].T  # leading products plus the product of the suffix norms
    left, right = np.nonzero(bound >= threshold - _SLACK)
    left, right = left + i.start, right + j.start
    if len(left) > bound.size // 16:  # most pairs go on: all products at once
        whole = a.y[i] @ b.y[j].T
        keep = whole[left - i.start, right - j.start] >= threshold - 1e-9
        left, right = left[keep], right[keep]
    else:
        total, done = np.zeros(len(left)), 0
        for stop in a.steps:
            total = total + np.einsum("ij,ij->i", a.y[left, done:stop], b.y[right, done:stop])
            keep = total + a.after[stop][left] * b.after[stop][right] >= threshold - 1e-9
            left, right, total, done = left[keep], right[keep], total[keep], stop
    # what is left is decided on the vectors as given, some at a time
    sure = np.zeros(len(left), bool)
    for at in range(0, len(left), 1 << 15):
        x, z = a.v[left[at : at + (1 << 15)]], b.v[right[at : at + (1 << 15)]]
        sure[at : at + (1 << 15)] = (x * z).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((z * z).sum(1))) >= threshold
    return left[sure], right[sure]


def forest(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect the same places as the given ones, fewer than there are places."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    # of many links most are between places that are joined already: first each left place with its first partner
    _, firsts = np.unique(left, return_index=True)
    _, others = np.unique(right, return_index=True)
    ahead = np.union1d(firsts, others)
    for x, z in zip(left[ahead].tolist(), right[ahead].tolist(), strict=True):
        p, q = top(x), top(z)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((x, z))
    names = np.unique(np.concatenate([left, right]))
    tops = np.array([top(x) for x in names.tolist()])
    p, q = tops[np.searchsorted(names, left)], tops[np.searchsorted(names, right)]
    open_ = np.flatnonzero(p != q)
    if len(open_):
        _, once = np.unique(p[open_] * (names[-1] + 1) + q[open_], return_index=True)
        for x, z in zip(left[open_[once]].tolist(), right[open_[once]].tolist(), strict=True):
            p, q = top(x), top(z)
            if p != q:
                root[max(p, q)] = min(p, q)
                kept.append((x, z))
    return kept


def compare(a: Side, b: Side | None, threshold: float) -> tuple[list, list, list]:
    """Columns (a, b, n): links of a forest with n null, and per row the copies it is linked to with b null.

    Without ``b`` the rows of ``a`` are compared among themselves.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    other = a if b is None else b
    shift = 0 if b is None else len(a.ids)
    counts, pairs = np.zeros(len(a.ids) + (0 if b is None else len(b.ids)), np.int64), []
    for s in range(0, len(a.ids), TILE):
        i = slice(s, min(s + TILE, len(a.ids)))
        for t in range(s if b is None else 0, len(other.ids), TILE):
            j = slice(t, min(t + TILE, len(other.ids)))
            # tiles are ordered by the first coordinate
            if other.y[j.start, 0] - a.y[i.stop - 1, 0] > reach or a.y[i.start, 0] - other.y[j.stop - 1, 0] > reach:
                continue
            left, right = linked(a, i, other, j, threshold)
            if b is None:
                keep = left < right
                left, right = left[keep], right[keep]
            if len(left):
                np.add.at(counts, left, other.copies[right])
                np.add.at(counts, right + shift, a.copies[left])
                pairs += forest(left, right + shift)
    ids = a.ids if b is None else np.concatenate([a.ids, b.ids])
    some = np.flatnonzero(counts)
    firsts = [int(ids[x]) for x, _ in pairs] + ids[some].tolist()
    seconds = [int(ids[z]) for _, z in pairs] + [None] * len(some)
    return firsts, seconds, [None] * len(pairs) + counts[some].tolist()


def near_duplicates(embeddings: DataFrame, stage: StageTables, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``embeddings``: vec_id, n_links, component_id, kept.

    A vector that is null, zero or holds null or non-finite components links with nothing and is its own component; so does a row
    with a null id, whose other columns are 0, null and null. Vectors of different lengths do not link; those of each length are compared
    among themselves. Equal vectors of different ids link. Rows that repeat an id and a vector are one vector, with equal results on each row.
    Other columns are not read. An empty table gives an empty result.
    """
    ids = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"))
    rows = stage.keep("near-valid", valid_vectors(embeddings).distinct())
    found = [_classes(own, stage, threshold, f"near-{i}") for i, own in enumerate(by_length(rows))]
    classes = functools.reduce(DataFrame.union, found) if found else rows.select("v", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id"))
    # rows of one id and different vectors: their links add up and their classes are one by the id; the smallest is shown
    per_id = rows.join(classes, "v").groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    known = stage.keep("near-result", per_id)
    return ids.join(known, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"),
    )


def _classes(rows: DataFrame, stage: StageTables, threshold: float, name: str) -> DataFrame:
    """(v, n_links, component_id) of every different vector of ``rows`` (vec_id, v), which are of one length."""
    unique = stage.keep(f"{name}-unique", rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    turn = rotation(unique)

    def lead(b: pa.RecordBatch) -> pa.RecordBatch:
        y = unit(as_matrix(b.column(0))) @ turn[:, :1]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(y[:, 0])], ["v", "rep", "copies", "y"])

    led = stage.keep(f"{name}-led", map_arrow(unique, "v binary, rep long, copies long, y double", lead))
    n_blocks = max(1, -(-led.count() // BLOCK))
    cuts = led.approxQuantile("y", [k / n_blocks for k in range(1, n_blocks)], 0.2 / n_blocks) if n_blocks > 1 else []
    cut = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")
    below = F.size(F.filter(cut, lambda c: c < F.col("y")))
    upto = F.size(F.filter(cut, lambda c: c <= F.col("y")))
    # rows that share a cut value are dealt over all blocks it bounds
    block = (below + F.pmod(F.xxhash64("rep"), upto - below + 1)).cast("int")
    blocked = stage.keep(f"{name}-blocks", led.withColumn("block", block))
    spans = blocked.groupBy("block").agg(F.min("y").alias("low"), F.max("y").alias("high")).orderBy("block").collect()
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    # blocks follow each other on the first coordinate, so those that a block must meet are neighbours
    meets = []
    for r in spans:
        own = [s["block"] for s in spans if s["low"] - r["high"] <= reach and r["low"] - s["high"] <= reach]
        meets.append((r["block"], min(own), max(own)))
    spark = rows.sparkSession
    near = spark.createDataFrame(meets, "block int, first int, last int")
    dealt = blocked.join(F.broadcast(near), "block").withColumn("other", F.explode(F.sequence("first", "last"))).select(
        "v", "rep", "copies", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"),
    )

    def pair(key, table):
        own = table.column("block").combine_chunks().to_numpy()
        sides = []
        for block in dict.fromkeys(k.as_py() for k in key):
            part = table.filter(pa.array(own == block))
            if len(part):
                column = lambda c, part=part: part.column(c).combine_chunks()
                sides.append(Side(column("rep").to_numpy(), column("copies").to_numpy(), as_matrix(column("v")), turn))
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
        if len(sides) < 2 and key[0] != key[1]:
            return schema.empty_table()
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in compare(sides[0], sides[1] if len(sides) > 1 else None, threshold)], schema=schema)

    found = stage.keep(f"{name}-found", dealt.groupBy("p", "q").applyInArrow(pair, "a long, b long, n long"))
    counts = found.filter("n IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    labels = components(found.filter("n IS NULL").select("a", "b"), stage, f"{name}-links")
    return stage.keep(
        f"{name}-classes",
        unique.join(counts, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
            "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"),
        ),
    )
