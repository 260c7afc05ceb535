"""Recall against brute force, exact scores, ties, odd rows."""

import numpy as np

from orderloom.llm import neighbours
from orderloom.llm.queries import QUERIES
from orderloom.sources.stage import StageTables


def brute(rows, k=20):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    ids = np.array(sorted(ok))
    x = np.stack([ok[i] for i in ids])
    out = {}
    for q in ids[ids % 20 == 0]:
        s = (x * ok[q]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_recall_and_scores(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    truth = brute(rows)
    by_id = {i: np.array(v, float) for i, v in rows}
    got = QUERIES["op1_neighbours"](spark, folder).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
        assert abs(r.score - (by_id[r.query_id] * by_id[r.vec_id]).sum()) < 1e-12
    assert set(found) == set(truth)
    for q, rs in found.items():
        rs.sort(key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, 21))
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(rs, rs[1:]))
    assert np.mean([len({r.vec_id for r in found[q]} & {i for i, _ in t}) / len(t) for q, t in truth.items()]) >= 0.9


def test_recall_when_only_a_share_is_opened(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest_rows(df, StageTables(spark)).collect()
    truth = brute(rows)
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(found[q] & {i for i, _ in t}) / len(t) for q, t in truth.items()]) >= 0.9


def test_walk_takes_pairs_by_sum():
    rng = np.random.default_rng(1)
    a, b, counts = rng.normal(size=9), rng.normal(size=7), rng.integers(0, 4, (9, 7))
    opened = neighbours.walk(a, b, counts, 40)
    pairs = sorted(((a[i] + b[j], i, j) for i in range(9) for j in range(7)), reverse=True)
    want, have = set(), 0
    for _, i, j in pairs:
        if have >= 40:
            break
        have += counts[i, j]
        if counts[i, j]:
            want.add((i, j))
    assert want == {(i, j) for i in range(9) for j in range(7) if opened[i] >> j & 1}


def test_ties_and_odd_rows(spark):
    same = [1.0, 2.0, 0.0, 1.0]
    rows = [(i, same) for i in range(100)] + [(200, None), (220, []), (240, [0.0] * 4), (260, [1.0, None, 1.0, 1.0]),
            (280, [float("nan")] * 4), (300, [1.0, 2.0]), (None, same), (40, same), (501, [0.0, 0.0, 1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, v string")
    got = {}
    for r in neighbours.nearest_rows(df, StageTables(spark)).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert set(got) == {0, 20, 40, 60, 80}
    for q, ranks in got.items():
        assert [ranks[i] for i in range(1, 21)] == [i for i in range(22) if i != q][:20]
    few = neighbours.nearest_rows(df.filter("vec_id in (0, 501, 3)"), StageTables(spark)).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(few)] == [(1, 3, 6.0), (2, 501, 0.0)]
    assert neighbours.nearest_rows(df.limit(0), StageTables(spark)).count() == 0


def test_more_equal_scores_than_ranks(spark):
    rng = np.random.default_rng(2)
    # 400 different vectors with the query's first component alone in common; scores tie at every rank
    rows = [(i, [1.0, *[float(x) for x in rng.permutation(np.eye(1, 30)[0])], *[float(x) for x in rng.integers(0, 2, 9)]]) for i in range(400)]
    rows = [(i, v) for i, v in rows if i % 20] + [(i, [1.0] + [0.0] * 39) for i in range(0, 400, 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in neighbours.nearest_rows(df, StageTables(spark)).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert {q: [x[i] for i in range(1, 21)] for q, x in got.items()} == brute(rows)


def found_by(spark, rows):
    out = {}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for r in sorted(neighbours.nearest_rows(df, StageTables(spark)).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_scales_change_no_neighbour(spark):
    rng = np.random.default_rng(8)
    base = [(i, np.round(rng.normal(size=8) * 64).tolist()) for i in range(60)]
    for power in (-500, 0, 500):
        rows = [(i, np.ldexp(v, power).tolist()) for i, v in base]
        truth = brute(rows)
        assert {q: [i for i, _ in x] for q, x in found_by(spark, rows).items()} == {q: [i for i, _ in x] for q, x in truth.items()}
    # squares beyond double precision: nothing is lost, and what is infinite ties
    huge = found_by(spark, [(i, (np.array(v) * 1e160).tolist()) for i, v in base])
    assert {q: len(x) for q, x in huge.items()} == {0: 20, 20: 20, 40: 20}


def test_every_length_has_its_own_neighbours(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.5, 0.0]), (20, [1.0, 0.0, 0.0]), (21, [2.0, 0.0, 0.0]), (40, [3.0])]
    assert found_by(spark, rows) == {0: [(1, 1.0), (2, 0.5)], 20: [(21, 2.0)]}
