"""Repeated windows against brute force: copies, edited copies, periodic texts, hot passages, odd rows, the statement."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from orderloom.llm import substrings
from orderloom.llm.queries import QUERIES, SQL
from orderloom.sources.stage import StageTables
from tests.conftest import SMALL
from tests.oracle_check import compare, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc is None, doc or 0, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def found(spark, rows, types="doc_id long, text string", parts=5, **more):
    df = substrings.digest(substrings.remove(spark.createDataFrame(rows, types).repartition(parts), StageTables(spark), **more))
    return sorted((r[0] is None, r[0] or 0, *r[1:]) for r in df.collect())


def corpus(n, seed, vocabulary=300, window=35):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passages = [[rng.choice(words) for _ in range(rng.randint(window - 3, 3 * window))] for _ in range(4)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.3:
            own = list(rng.choice(texts[-15:]))
            for _ in range(rng.randint(0, 4)):
                if own:
                    at = rng.randrange(len(own))
                    own[at : at + rng.randint(0, 2)] = [rng.choice(words) for _ in range(rng.randint(0, 2))]
        elif kind < 0.4:
            own = (rng.sample(words, rng.randint(1, 3)) * 100)[: rng.randint(1, 150)]
        else:
            own = [rng.choice(words) for _ in range(rng.randint(0, 150))]
            if rng.random() < 0.6:
                at = rng.randint(0, len(own))
                own[at:at] = rng.choice(passages)[rng.randint(0, 3) :]
        texts.append(own)
    return [(i, rng.choice([" ", "  ", "\t", "\n", "\x0b "]).join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(160, seed)
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("window, seed", [(35, 1), (35, 35), (7, 3), (2, 1)])
def test_other_windows(spark, window, seed):
    rows = corpus(40, window, 60, 8)
    assert found(spark, rows, window=window, seed=seed) == brute(rows, window)


def test_small_portions_stretches_and_hot_anchors(spark, monkeypatch):
    # few bytes a portion, so nothing meets in a task, and every kind but the first of an anchor is dealt out
    for name, value in (("PORTION_BYTES", 500), ("STRETCH", 40), ("AT_HOME", 1)):
        monkeypatch.setattr(substrings, name, value)
    rng = random.Random(5)
    hot = [f"h{i}" for i in range(40)]
    rows = corpus(60, 6) + [
        (100 + i, " ".join([f"a{rng.randrange(3)}" for _ in range(30)] + hot + [f"b{rng.randrange(3)}" for _ in range(30)])) for i in range(60)
    ]
    assert found(spark, rows) == brute(rows)


def test_meeting_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = corpus(50, 8)
        assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "x0 x1"), (5, long), (5, long), (None, long + " end"), (None, None), (0, long), (6, "é 中 文 " * 40), (7, "X0 " + long[3:])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(*r, 1, 2, "h", [3]) for r in rows], "doc_id long, text string, a long, b long, h string, rows array<int>") == brute(rows)
    assert found(spark, []) == []


def test_a_very_long_text(spark):
    rng = random.Random(9)
    words = [str(rng.randrange(10**6)) for _ in range(900_000)]
    words[800_000:800_050] = words[100:150]
    rows = [(1, " ".join(words)), (2, " ".join(words[600_000:600_035]))]
    assert found(spark, rows) == brute(rows)


def test_spans_are_maximal(spark):
    long = " ".join(f"x{i}" for i in range(80))
    rows = [(1, "a b " + long + " c"), (2, long + " d"), (3, " ".join(long.split()[10:50]))]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in substrings.remove(spark.createDataFrame(rows, "doc_id long, text string"), StageTables(spark)).collect()}
    assert got == {1: [(2, 82)], 2: [(0, 80)], 3: [(0, 40)]}


def test_every_window_has_its_anchor():
    rng = np.random.default_rng(3)
    seed = rng.integers(0, 6, 400).astype(np.uint64)  # many ties
    for reach in (1, 2, 3, 24, 33):
        want = [i + max(j for j in range(reach) if seed[i + j] == seed[i : i + reach].min()) for i in range(400 - reach + 1)]
        assert substrings.anchors(seed, reach).tolist() == want


def test_statement(spark):
    assert compare(QUERIES["op13_substrings"](spark, SMALL), connect(SMALL), SQL["op13_substrings"])[0] is None
