"""Mixing sources to target weights by the cube method.

Every source gets a target number of words. A document is taken a whole number of times plus once more
with a probability that is the same all over its source; the once-mores are drawn by the cube method:
fractional probabilities move along the null space of the balancing constraints (documents and words)
until they are 0 or 1. A step needs three fractional documents, so the flight streams over rows and keeps
no more than those. What is left of each block (two at most) flies again with the leftovers of other
blocks, until one block per source is left; its last two are landed on the closest total of words.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import small_side
from orderloom.operators.prefix import ONE_TASK_ROWS, global_prefix, rank_in_group
from orderloom.sources.stage import StageTables

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words, so some documents are repeated
MOST = 2  # times a source's words, and times a document
BLOCK_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, stage: StageTables, weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per source: source, source_size, n_docs, target. One row per source is read, whatever a source holds.

    Weights repeat over the sources in code point order, a null source last. A target above ``MOST`` times its
    source's size stops there and the excess is shared anew by weight; totals are whole numbers, so the order of sums
    cannot change a target.
    """
    summed = stage.keep("mix-sums", sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    ranked = global_prefix(summed, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = stage.keep("mix-sources", ranked.select("source", "source_size", "n_docs", weight.cast("long").alias("weight")))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    most, rate = F.col("source_size") * MOST, None
    while True:
        # sources that stop at their most once the rate is ``rate``; the rate only rises, so none starts again
        stopped = F.lit(False) if rate is None else F.col("weight") * F.lit(rate[0]) > most * F.lit(rate[1])
        row = ranked.agg(
            F.coalesce(F.sum(F.when(stopped, most)), F.lit(0)), F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0)),
        ).first()
        now = (share * total - row[0], row[1])
        if now == rate or not row[1]:
            break
        rate = now
    target = F.when(stopped, most.cast("double")).otherwise(F.lit(float(now[0])) * F.col("weight") / F.lit(float(max(now[1], 1))))
    return ranked.select("source", "source_size", "n_docs", target.alias("target"))


def step(held: list[list], rng: random.Random) -> None:
    """Move three fractional rows [.., size, p] along the null space of (documents, words) until one is 0 or 1."""
    (a, b, c) = (h[-2] for h in held)
    way = (b - c, c - a, a - b) if a != b or b != c else (1, -1, 0)
    ahead = min(((1 - h[-1]) / u if u > 0 else -h[-1] / u) for h, u in zip(held, way, strict=True) if u)
    back = min((h[-1] / u if u > 0 else -(1 - h[-1]) / u) for h, u in zip(held, way, strict=True) if u)
    move = ahead if rng.random() * (ahead + back) < back else -back
    for h, u in zip(held, way, strict=True):
        p = h[-1] + move * u
        h[-1] = 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p


def land(held: list[list]) -> None:
    """Give the last rows 0 or 1 so that their words come closest to what was due."""
    due = sum(h[-2] * h[-1] for h in held)
    best = min(itertools.product((0.0, 1.0), repeat=len(held)), key=lambda s: abs(sum(h[-2] * x for h, x in zip(held, s, strict=True)) - due))
    for h, x in zip(held, best, strict=True):
        h[-1] = x


def _flight(names: list[str], last: bool):
    """Fly the rows (.., _group, size, p) of each group in their order; with ``last`` also land what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, rng, done, schema = None, [], random.Random(), [], None

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            schema = pa.schema([b.schema.field(n) for n in names])
            for row in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names), strict=True):
                if row[-3] != group:
                    if last:
                        land(held)
                    done += held
                    group, held, rng = row[-3], [], random.Random(row[-3])
                held.append(list(row))
                if len(held) == 3:
                    step(held, rng)
                    done += [h for h in held if h[-1] in (0.0, 1.0)]
                    held = [h for h in held if h[-1] not in (0.0, 1.0)]
            if done:
                yield out()
                done = []
        if last:
            land(held)
        done += held
        if done:
            yield out()

    return run


def fly(rows: DataFrame, stage: StageTables, name: str = "mix") -> DataFrame:
    """``rows`` (source, key, size, p) with every p of 0..1 turned into 0 or 1.

    Rows are dealt into blocks by a hash of the key; the number of blocks follows the source's rows, and
    within a block rows go in key order, so a rerun gives the same draw.
    """
    names = ["source", "key", "id", "_group", "size", "p"]
    types = "source string, key long, id long, _group string, size long, p double"
    parts, open_rows, turn = [], rows.filter("p > 0 AND p < 1"), 0
    parts.append(rows.filter("p <= 0 OR p >= 1").select("source", "key", "id", "size", "p"))
    while True:
        counts = stage.keep(f"{name}-blocks-{turn}", open_rows.groupBy("source").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("_n")))
        last = (counts.agg(F.max("_n")).first()[0] or 1) == 1
        # no column of ``open_rows`` starts with an underscore
        dealt = open_rows.join(small_side(counts), open_rows["source"].eqNullSafe(counts["source"])).select(
            open_rows["source"], "key", "id", "size", "p",
            F.concat_ws("|", F.lit(turn), F.pmod(F.xxhash64("key"), F.col("_n")), F.coalesce(open_rows["source"], F.lit("\0"))).alias("_group"),
        )
        flown = dealt.repartition("_group").sortWithinPartitions("_group", F.xxhash64("key", "size"), "key", "id").select(*names)
        flown = stage.keep(f"{name}-flown-{turn}", flown.mapInArrow(_flight(names, last), types))
        parts.append(flown.filter("p = 0 OR p = 1").select("source", "key", "id", "size", "p"))
        if last:
            break
        open_rows, turn = flown.filter("p > 0 AND p < 1").select("source", "key", "id", "size", "p"), turn + 1
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def mix(docs: DataFrame, stage: StageTables, weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, size, source, source_size, target, copies, taken.

    ``size`` is the number of words of the whole text (null: 0), ``copies`` how often the mix takes the
    document (0 to ``MOST``), ``taken`` the words that makes. A null source is a source of its own. Null ids and
    repeated rows each count. ``key`` is a hash of the row's id, source and text. Other columns are not read. An
    empty table gives an empty result.
    """
    sizes = stage.keep("mix-sizes", docs.select(
        F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), row_key(docs).alias("key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ))
    targets = stage.keep("mix-targets", source_targets(sizes, stage, weights, share))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = stage.keep("mix-rates", targets.select("*", F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("p")))
    near = small_side(rates)
    rated = sizes.join(near, sizes["source"].eqNullSafe(rates["source"])).select(sizes["source"], "key", "id", "size", "p")
    drawn = fly(rated, stage)
    return drawn.withColumnRenamed("p", "drawn").join(near, drawn["source"].eqNullSafe(rates["source"])).select(
        F.col("id").alias("doc_id"), "key", "size", drawn["source"], "source_size", "target",
        (F.col("whole") + F.col("drawn").cast("long")).alias("copies"), (F.col("size") * (F.col("whole") + F.col("drawn").cast("long"))).alias("taken"),
    )


def row_key(docs: DataFrame):
    return F.xxhash64(docs["doc_id"].cast("long"), docs["source"], docs["text"])


def apply(docs: DataFrame, stage: StageTables, weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it; rows taken 0 times go.

    Equal rows share one key, so their copies are added up and dealt over them. Only rows whose copies do not divide evenly
    are numbered, over key ranges, so a group of any size stays spread. Null texts, ids and sources count as in ``mix``; a row travels as
    one struct, so its columns may have any names; an empty table stays empty.
    """
    decided = stage.keep("mix-decided", mix(docs, stage, weights, share).groupBy(F.col("key").alias("_key")).agg(
        F.sum("copies").alias("_copies"), F.count("*").alias("_rows"),
    ))
    joined = docs.select(F.struct(*docs.columns).alias("_row"), row_key(docs).alias("_key")).join(small_side(decided), "_key")
    even, left = F.floor(F.col("_copies") / F.col("_rows")), F.col("_copies") % F.col("_rows")

    def repeated(rows: DataFrame, times: Column) -> DataFrame:
        return rows.withColumn("_each", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select("_row.*")

    if not decided.filter(left > 0).limit(1).count():
        return repeated(joined, even)
    # equal rows differ in the last column of the order alone, so that ranges can part them
    placed = stage.keep("mix-uneven", joined.filter(left > 0).withColumn("_order", F.xxhash64("_row")).withColumn("_lot", F.rand(1)))
    turned = rank_in_group(placed, ["_key"], [F.col("_order"), F.col("_lot")], ONE_TASK_ROWS + 1, "_turn")
    return repeated(joined.filter(left == 0), even).unionByName(repeated(turned, even + (F.col("_turn") <= left).cast("int")))
