"""How sources of a language differ from each other, and which terms set a source apart.

One translate table per text lowers A-Z and blanks every other ASCII sign, so ``split`` gives the terms and a Counter per
document their counts. Tasks add the Counters up per (lang, source) and hand out sparse rows; Spark sums them.

Two sources are compared over all kept terms, also those that neither uses, without visiting these: with p0 the share of a
term of count 0, a term that both hold adds f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0) to what the histogram of
each source's counts gives against the other's p0, and V * f(p0, q0) is added once. Terms are visited in runs, so
no pairs of rows are shuffled; sums per pair of sources are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm.common import slices, small_side
from orderloom.sources.stage import StageTables

LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
HELD_TERMS = 400_000  # different terms that a task adds up before it hands them out
PORTION_BYTES = 4 << 20
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_ROWS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term of one text, which is split some megabytes at a time."""
    blanked, counts, at = text.translate(_TABLE), Counter(), 0
    while at < len(blanked):
        to = blanked.find(b" ", at + PORTION_BYTES)
        to = len(blanked) if to < 0 else to
        counts.update(blanked[at:to].split())
        at = to
    return counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of (lang, source, term) over the rows of a task; a row with an empty term tells that the group occurs."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def out() -> pa.RecordBatch:
        columns = [[], [], [], [], []]
        for (lang, source), (n, docs) in held.items():
            size = len(n) + 1
            for column, values in zip(columns, ([lang] * size, [source] * size, [b"", *n], [0, *n.values()], [0, *map(docs.__getitem__, n)]), strict=True):
                column += values
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROWS, strict=True)], schema=_ROWS)

    for whole in batches:
        for b in slices(whole, 2, PORTION_BYTES):
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = term_counts(text)
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                n.update(own)
                docs.update(iter(own))
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                yield out()
                held.clear()
    if held:
        yield out()


def share(n: str, total: str, kept: str) -> str:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)) in exact arithmetic; null without kept terms."""
    return f"if({kept} > 0, 1 + cast({n} + 2 as decimal(20,0)) * {SCALE}BD div cast({total} + 2 * {kept} as decimal(20,0)), null)"


def gap(p: str, q: str) -> str:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so 64 bits hold it."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q}))"


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, term, place, p, p0) sorted by lang and term: per batch and pair of places the sum over terms that both hold."""

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    def sums(rows: pa.Table, run: np.ndarray) -> pa.RecordBatch | None:
        lang = rows.column("lang").combine_chunks().dictionary_encode()
        place, p, p0 = (rows.column(c).to_numpy() for c in ("place", "p", "p0"))
        keys, values = [], []
        for step in range(1, len(run)):
            first = np.flatnonzero(run[:-step] == run[step:])
            if not len(first):
                break  # no run is longer than ``step`` rows
            a, b = first, first + step
            a, b = np.where(place[a] < place[b], a, b), np.where(place[a] < place[b], b, a)
            keys.append(np.stack([lang.indices.to_numpy()[a], place[a], place[b]], 1))
            values.append(f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b]))
        if not keys:
            return None
        key, at = np.unique(np.concatenate(keys), axis=0, return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, at.ravel(), np.concatenate(values))
        names = lang.dictionary.take(pa.array(key[:, 0]))
        return pa.RecordBatch.from_arrays([names, pa.array(key[:, 1]), pa.array(key[:, 2]), pa.array(total)], ["lang", "i", "j", "value"])

    rest = None
    for b in batches:
        rows = pa.Table.from_batches([b])
        rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
        run = _runs(rows)
        last = int(np.searchsorted(run, run[-1])) if len(run) else 0
        out = sums(rows.slice(0, last), run[:last]) if last else None
        rest = rows.slice(last)
        if out is not None:
            yield out
    if rest is not None and rest.num_rows:
        out = sums(rest, _runs(rest))
        if out is not None:
            yield out


def _runs(rows: pa.Table) -> np.ndarray:
    """Numbers of the runs of equal (lang, term)."""
    fresh = np.zeros(rows.num_rows, np.int64)
    for c in ("lang", "term"):
        codes = rows.column(c).combine_chunks().dictionary_encode().indices.to_numpy()
        fresh[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(fresh)


def audit(docs: DataFrame, stage: StageTables, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): ``pair`` for every two sources of a language, ``term`` for a source's own terms.

    Null text, lang and source count as empty ones. Texts without terms and languages without kept terms still give their
    groups and pairs (of value 0). Repeated rows are documents of their own; ties go by the item's bytes. Only these three
    columns are read, so others cannot clash; an empty table gives an empty result. The rows of one term are at most the
    sources of its language, and the result has a row for every two of these.
    """
    narrow = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
                         F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    counted = narrow.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    summed = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    kept = stage.keep("terms", summed.select(
        "lang", "term", "source", "n", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("term_docs"),
        (F.row_number().over(term.orderBy("source")) == 1).cast("long").alias("first"),
    ).filter((F.col("term_docs") >= least_docs) | (F.octet_length("term") == 0)).drop("term_docs"))
    terms = kept.filter(F.octet_length("term") > 0)
    langs = kept.groupBy("lang").agg(F.sum(F.when(F.octet_length("term") > 0, F.col("first")).otherwise(0)).alias("v"), F.sum("n").alias("lang_total"))
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(langs, "lang").withColumn(
        "place", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long"),
    ).withColumn("p0", F.expr(share("0", "total", "v")))
    groups = stage.keep("groups", groups)
    near = small_side(groups)
    shares = stage.keep("shares", terms.join(near, ["lang", "source"]).select(
        "lang", "term", "source", "place", "n", F.expr(share("n", "total", "v")).alias("p"), F.expr(share("lang_n", "lang_total", "v")).alias("q"), "p0",
    ))
    return _pairs(shares, groups, near).unionByName(_terms(shares, top))


def _pairs(shares: DataFrame, groups: DataFrame, near: DataFrame) -> DataFrame:
    other = near.select("lang", F.col("place").alias("j"), F.col("p0").alias("q0"))
    mine = groups.select("lang", F.col("place").alias("i"), "p0", "v")
    both = mine.join(other, "lang").filter("i <> j")
    base = both.select("lang", "i", "j", F.expr(f"if(v > 0, v * ({gap('p0', 'q0')}), 0)").alias("value"))
    # what a source's own counts add against a term that the other lacks; equal counts are visited once
    counts = shares.groupBy("lang", F.col("place").alias("i"), "p", "p0").agg(F.count("*").alias("c"))
    own = counts.join(other, "lang").filter("i <> j").select(
        "lang", "i", "j", F.expr(f"c * (({gap('p', 'q0')}) - ({gap('p0', 'q0')}))").alias("value"),
    ).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    met = shares.select("lang", "term", "place", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(
        _meetings, "lang string, i long, j long, value long",
    ).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    halves = own.unionByName(met)
    total = base.unionByName(halves).unionByName(halves.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    named = near.select("lang", "source", "place")
    summed = total.groupBy("lang", "i", "j").agg(F.sum("value").alias("value")).join(named.withColumnRenamed("place", "i"), ["lang", "i"]).join(
        named.select("lang", F.col("source").alias("item"), F.col("place").alias("j")), ["lang", "j"],
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(shares: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    ranked = shares.filter("p > q").select("lang", "source", "term", F.expr(gap("p", "q")).alias("value")).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")
