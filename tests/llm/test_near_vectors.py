"""Links against brute force, the statement, tile pairs, odd rows."""

import numpy as np
import pytest

from orderloom.llm import near_vectors
from orderloom.llm.queries import QUERIES, SQL
from orderloom.sources.stage import StageTables
from tests.llm.brute import classes
from tests.conftest import SMALL
from tests.oracle_check import compare, connect


def brute(rows, threshold=0.9):
    ok = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    ids = list(ok)
    x = np.stack([ok[i] / np.linalg.norm(ok[i]) for i in ids]) if ids else np.zeros((0, 1))
    links = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1)))]
    n = {i: 0 for i, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    root = classes(n, links)
    return {i: (n[i], root[i], root[i] == i) for i in n}


def cloud(n, seed, d=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, d))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(scale=0.25, size=(n, d))
    x[::9] = x[0]  # a large group of copies
    x[5::31] *= 3.5
    return [(i, row.tolist()) for i, row in enumerate(x)]


@pytest.mark.parametrize("block,tile", [(8192, 1024), (64, 16)])
def test_equals_brute_force(spark, monkeypatch, block, tile):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    monkeypatch.setattr(near_vectors, "TILE", tile)
    rows = cloud(900, 2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_duplicates(df, StageTables(spark)).collect()}
    assert got == brute(rows)


def test_tile_pairs_by_bounds_equal_whole_products():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 16))
    v[150:] = v[:150] + rng.normal(scale=0.3, size=(150, 16))
    turn = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    side = near_vectors.Side(np.arange(300), np.ones(300, int), v, turn)
    left, right = near_vectors.linked(side, slice(0, 300), side, slice(0, 300), 0.9)
    x = side.v / np.linalg.norm(side.v, axis=1)[:, None]
    want = np.argwhere(x @ x.T >= 0.9)
    assert {*zip(left.tolist(), right.tolist())} == {tuple(p) for p in want.tolist()}


def test_query_equals_statement(spark):
    difference, n = compare(QUERIES["op6_near_vectors"](spark, SMALL), connect(SMALL), SQL["op6_near_vectors"])
    assert difference is None and n > 0, difference


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("inf"), 1.0]), (8, [1.0, 0.0, 0.0]), (9, [0.0, 1.0]),
            (1, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, v string, n int")
    got = sorted(tuple(r) for r in near_vectors.near_duplicates(df, StageTables(spark)).collect())
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)]
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), *alone]
    none = spark.createDataFrame([(None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in near_vectors.near_duplicates(none, StageTables(spark)).collect()] == [(None, 0, None, None)]
    assert near_vectors.near_duplicates(df.limit(0), StageTables(spark)).count() == 0


@pytest.mark.parametrize("scale", [1e-200, 5e-324, 1.0, 1e200])
def test_scales_change_no_link(spark, scale):
    rows = [(i, [round(x * 8) * scale for x in v]) for i, v in cloud(120, 4, 4)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_duplicates(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>"), StageTables(spark)).collect()}
    assert got == brute([(i, [x / scale for x in v]) for i, v in rows])


def test_every_length_is_compared_with_its_own(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.01, 0.0]), (6, [2.0])]
    got = [tuple(r) for r in near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), StageTables(spark)).orderBy("vec_id").collect()]
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True)]
