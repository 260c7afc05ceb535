"""Nearest neighbours by an inverted multi-index.

Each half of a vector is quantised on its own, so K centroids per half make K x K cells. A query walks
the pairs of centroids from the best sum downwards with a heap until the cells it opened hold the wanted share
of all entries; these entries are then ranked exactly. Entries and queries meet per first-half centroid, cut
into tiles of bounded size on both sides, and only each tile's best come out.
"""

from __future__ import annotations

import functools
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import map_arrow
from orderloom.llm.vectors import as_matrix, by_length, distinct_vectors, scaled, valid_vectors
from orderloom.sources.stage import StageTables

CENTROIDS = 64  # per half; a query's open cells of one first-half centroid are the bits of one long
SAMPLE = 20_000  # vectors the centroids are fitted on, at most
ROUNDS = 12
SHARE, LEAST = 0.5, 2000  # a query opens cells until they hold this share of all entries, and this many
TILE = 4096


@dataclass
class Index:
    entries: DataFrame  # v, ids, c1, c2
    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray  # entries per cell
    keep: int  # ids kept per different vector


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * (x @ centres.T)).argmin(1)


def build(vectors: DataFrame, stage: StageTables, keep: int, centroids: int = CENTROIDS, sample: int = SAMPLE, name: str = "imi") -> Index:
    """Index every different vector of ``vectors`` (vec_id, v), each with its ``keep`` smallest ids."""
    unique = stage.keep(f"{name}-vectors", distinct_vectors(vectors, keep))
    n = unique.count()
    key = F.pmod(F.xxhash64("v"), F.lit(1 << 30))
    drawn = unique.filter(key < int(min(1.0, 1.1 * sample / max(1, n)) * (1 << 30))).select("v").collect()
    x = np.stack([np.frombuffer(r["v"], "<f8") for r in sorted(drawn)[:sample]]) if drawn else np.zeros((1, 2))
    if not drawn and n:  # a handful of vectors of which the hash took none
        x = np.stack([np.frombuffer(r["v"], "<f8") for r in unique.limit(sample).select("v").collect()])
    # one power of two for all vectors, so that squares neither overflow nor vanish and products keep their order
    shift = -int(np.frexp(np.abs(x).max())[1])
    x, half = np.ldexp(x, shift), x.shape[1] // 2
    first, second = kmeans(x[:, :half], centroids, 1), kmeans(x[:, half:], centroids, 2)

    def assign(b: pa.RecordBatch) -> pa.RecordBatch:
        m = np.clip(np.ldexp(as_matrix(b.column(0)), shift), -1e100, 1e100)
        cells = [pa.array(nearest(m[:, :half], first).astype(np.int32)), pa.array(nearest(m[:, half:], second).astype(np.int32))]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cells], ["v", "ids", "c1", "c2"])

    entries = stage.keep(f"{name}-entries", map_arrow(unique, "v binary, ids array<bigint>, c1 int, c2 int", assign))
    counts = np.zeros((len(first), len(second)), np.int64)
    for r in entries.groupBy("c1", "c2").count().collect():  # at most K x K rows
        counts[r["c1"], r["c2"]] = r["count"]
    return Index(entries, first, second, counts, keep)


def walk(a: np.ndarray, b: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Bits of the opened second-half centroids per first-half one: pairs by falling a[i] + b[j] until they hold ``wanted``."""
    up, down = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
    x, y, rows = a[up].tolist(), b[down].tolist(), counts[np.ix_(up, down)].tolist()
    opened, have = [0] * len(a), 0
    heap = [(-(x[0] + y[0]), 0, 0)]
    while heap and have < wanted:
        _, i, j = heapq.heappop(heap)
        if rows[i][j]:
            opened[up[i]] |= 1 << down[j]
            have += rows[i][j]
        # a pair is reached from its left neighbour, the first of a row from the row before
        if j + 1 < len(y):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))
    return opened


def search(index: Index, queries: DataFrame, k: int, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` entries per query of largest inner product, never the query's own id.

    Ties go to the smaller vec_id. ``queries`` is (query_id, v). A query of repeated id is searched once per vector
    and its results are merged. Vectors of another length than the index find nothing.
    """
    counts, first, second, keep = index.counts, index.first, index.second, index.keep
    half, total = first.shape[1], int(index.counts.sum())
    wanted = max(int(share * total), min(total, least))
    width = 8 * (first.shape[1] + second.shape[1])
    tiles = np.maximum(1, -(-counts.sum(1) // TILE))

    def open_cells(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, vectors, shards, masks = [], [], [], []
        for query, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            v = scaled(np.frombuffer(raw, "<f8")[None, :])[0]
            for shard, mask in enumerate(walk(first @ v[:half], second @ v[half:], counts, wanted)):
                if mask:
                    ids.append(query)
                    vectors.append(raw)
                    shards.append(shard)
                    masks.append(mask - (1 << 64) if mask >> 63 else mask)
        arrays = [pa.array(ids, pa.int64()), pa.array(vectors, pa.binary()), pa.array(shards, pa.int32()), pa.array(masks, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["query_id", "v", "c1", "mask"])

    asked = queries.filter(F.octet_length("v") == width).distinct()
    n_asked = asked.count()
    parts = max(1, -(-n_asked // TILE))
    tile_count = F.element_at(F.array(*[F.lit(int(t)) for t in tiles]), F.col("c1") + 1)
    opened = map_arrow(asked.repartition(max(8, -(-n_asked // 200)), "query_id"), "query_id long, v binary, c1 int, mask long", open_cells)
    left = opened.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).withColumn(
        "tile", F.explode(F.sequence(F.lit(0), tile_count - 1))
    )
    right = index.entries.withColumn("tile", F.pmod(F.xxhash64("v"), tile_count).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    )

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "c1": [], "ids": [], "scores": []}
        if len(left) and len(right):
            column = lambda t, c: t.column(c).combine_chunks()
            q, v = as_matrix(column(left, "v")), as_matrix(column(right, "v"))
            mask = column(left, "mask").to_numpy().view(np.uint64)
            ids, cell = right.column("ids").to_pylist(), column(right, "c2").to_numpy().astype(np.uint64)
            names, shard = left.column("query_id").to_pylist(), left.column("c1")[0].as_py()
            lowest = np.array([i[0] for i in ids])
            # products of the matrix and exact ones differ by rounding only
            size = lambda x: np.abs(x).max(1) * np.sqrt(x.shape[1])  # noqa: E731  no less than the norm
            with np.errstate(over="ignore"):
                slack = 4 * v.shape[1] * np.finfo(float).eps * size(v).max() * size(q)
            for at in range(0, len(q), 256):
                seen = (mask[at : at + 256, None] >> cell[None, :]) & np.uint64(1)
                with np.errstate(over="ignore", invalid="ignore"):
                    near = q[at : at + 256] @ v.T
                # products beyond double precision are decided by the exact ones
                near = np.where(seen, np.where(np.isfinite(near), near, np.inf), -np.inf)
                few = min(k + 1, near.shape[1])  # one may be the query's own
                least = -np.partition(-near, few - 1, axis=1)[:, few - 1]
                with np.errstate(invalid="ignore"):
                    least = np.where(np.isfinite(slack[at : at + 256]), least - slack[at : at + 256], -np.inf)
                for row in range(len(near)):
                    own = np.flatnonzero((near[row] >= least[row]) & seen[row].astype(bool))
                    if not len(own):
                        continue
                    with np.errstate(over="ignore", invalid="ignore"):
                        exact = np.nan_to_num((v[own] * q[at + row]).sum(1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                    # an entry behind k + 1 others by score and smallest id has nothing among the first k
                    first_ones = np.lexsort((lowest[own], -exact))[:few]
                    own, exact = own[first_ones], exact[first_ones]
                    name = names[at + row]
                    found = sorted((-s, i) for s, j in zip(exact.tolist(), own.tolist(), strict=True) for i in ids[j] if i != name)[:k]
                    if found:
                        out["query_id"].append(name)
                        out["c1"].append(shard)
                        out["ids"].append([i for _, i in found])
                        out["scores"].append([-s for s, _ in found])
        return pa.table(out, pa.schema([("query_id", pa.int64()), ("c1", pa.int32()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))]))

    assert keep > k, "an entry must hold one id more than is asked for, as one may be the query's own"
    key = ["c1", "part", "tile"]
    best = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(rank, "query_id long, c1 int, ids array<bigint>, scores array<double>")
    pairs = best.withColumn("found", F.transform(F.arrays_zip("ids", "scores"), lambda p: F.struct((-p["scores"]).alias("s"), p["ids"].alias("i"))))
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found")
    # first per shard, then per query, so no list holds more than a shard's tiles or the shards
    top = pairs.groupBy("query_id", "c1").agg(merged).groupBy("query_id").agg(merged)
    return top.select("query_id", F.posexplode("found").alias("at", "f")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.i").alias("vec_id"), (-F.col("f.s")).alias("score")
    )


def nearest_rows(embeddings: DataFrame, stage: StageTables, k: int = 20, divisor: int = 20, **how) -> DataFrame:
    """Search all of ``embeddings`` with the rows whose id ``divisor`` divides.

    Null ids and vectors that are null, zero or hold null or non-finite components take no part. Equal vectors and
    repeated rows tie and go by id. A query's candidates are the vectors of its length. Products beyond double precision are infinite, tie
    and go by id. An empty table gives an empty result. Other columns are not read.
    """
    valid, found = stage.keep("imi-valid", valid_vectors(embeddings)), []
    for i, vectors in enumerate(by_length(valid)):
        index = build(vectors, stage, k + 1, name=f"imi-{i}")
        queries = vectors.filter(F.col("vec_id") % divisor == 0).select(F.col("vec_id").alias("query_id"), "v")
        found.append(search(index, queries, k, **how))
    if not found:
        return valid.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    return functools.reduce(DataFrame.union, found)
