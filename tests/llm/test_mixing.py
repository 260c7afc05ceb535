"""Targets by hand and against plain resharing, balance of the draw, odd rows."""

import random
from collections import defaultdict

import pytest

from orderloom.llm import mixing
from orderloom.llm.queries import QUERIES
from orderloom.sources.stage import StageTables
from tests.conftest import SMALL


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    pot, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        rate = pot / max(1, sum(weight[s] for s in free))
        over = {s for s in free if rate * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: rate * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            pot -= target[s]
        free -= over


def check(rows, slack=1.0):
    own, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        own[r.source] += r.size
        largest[r.source] = max(largest[r.source], r.size)
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
    target = plain_targets(own)
    for r in rows:
        assert r.source_size == own[r.source] and r.target == pytest.approx(target[r.source], rel=1e-12)
    for s in own:
        assert abs(taken[s] - target[s]) <= slack * largest[s] + 1, s


def test_query(spark):
    sizes = {r.doc_id: len((r.text or "").split()) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op10_mixing"](spark, SMALL).collect()
    assert {r.doc_id: r.size for r in rows} == sizes
    check(rows)
    again = QUERIES["op10_mixing"](spark, SMALL).collect()
    assert sorted(rows) == sorted(again)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 50)
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([1, 5, 5, 40, 300]), "a" if i % 3 else rng.choice(["b", "c", "d", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, StageTables(spark)).collect()
    assert len(out) == 3000
    check(out)
    # document totals are balanced as well
    for s in "abcd":
        own = [r for r in out if r.source == s]
        due = own[0].target / own[0].source_size * len(own)
        assert abs(sum(r.copies for r in own) - due) < 4


def test_draw_is_unbiased():
    hits = [0, 0, 0]
    for seed in range(4000):
        held = [["a", "g", 5, 0.3], ["b", "g", 9, 0.3], ["c", "g", 2, 0.3]]
        rng = random.Random(seed)
        mixing.step(held, rng)
        for i, h in enumerate(held):
            hits[i] += h[-1]
    assert all(abs(h / 4000 - 0.3) < 0.02 for h in hits)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", None), (3, "x", "b"), (3, "x", "b"), (4, "one two three", "")]
    df = spark.createDataFrame([(*r, 5, 0.5) for r in rows], "doc_id long, text string, source string, size int, p double")
    out = mixing.mix(df, StageTables(spark)).collect()
    assert len(out) == len(rows)
    check(out)
    taken = mixing.apply(df, StageTables(spark))
    assert taken.columns == df.columns and taken.count() == sum(r.copies for r in out)
    assert mixing.mix(df.limit(0), StageTables(spark)).count() == 0
    check(mixing.mix(df.filter("doc_id < 3"), StageTables(spark)).collect())


def test_equal_rows_do_not_meet_in_one_task(spark):
    from pyspark.sql import functions as F

    rows = [(None, "a b c", "s", "en" if i % 2 else "fr") for i in range(3000)] + [(i, "x " * (1 + i % 7), "s" if i % 2 else "t", "en") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(8)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        copies = sum(r.copies for r in mixing.mix(df, StageTables(spark)).collect() if r.doc_id is None)
        taken = mixing.apply(df, StageTables(spark))
        hot = [r["count"] for r in taken.filter("doc_id IS NULL").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert copies % 3000 and sum(hot) == copies and max(hot) < copies / 2
    assert [tuple(r) for r in taken.groupBy("lang").count().orderBy("lang").collect()] == [tuple(r) for r in mixing.apply(df, StageTables(spark)).groupBy("lang").count().orderBy("lang").collect()]
