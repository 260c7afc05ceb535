"""Links against brute force: signatures, trees, large classes, odd rows, the statement."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from orderloom.llm import jaccard
from orderloom.llm.queries import QUERIES, SQL
from orderloom.llm.shingles import Hasher
from orderloom.llm.stages import NEAR
from orderloom.sources.stage import StageTables
from tests.llm.brute import classes
from tests.oracle_check import compare, connect

RULE = jaccard.Rule(4, 85)


def plain_set(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def brute(rows, n=4, percent=85):
    sets = {i: plain_set(t, n) for i, t in rows}
    links = [
        (a, b) for a, b in itertools.combinations(sorted(sets), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    root = classes(sets, links)
    return {i: (len(sets[i]), root[i]) for i in sets}


def corpus(n, seed, largest=80):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base, out = [], []
    for i in range(n):
        if base and rng.random() < 0.6:
            own = list(rng.choice(base[-12:]))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                own[rng.randrange(len(own))] = rng.choice(words)
        else:
            own = [rng.choice(words) for _ in range(rng.randint(1, largest))]
        base.append(own)
        out.append((i, " ".join(own)))
    return out


def test_shingles():
    texts = ["A b\tC d e", "a B c", "", None, "é É x y z\x0b é É x y", " lead  trail ", "a b c d e", "É b c d É b c d É"]
    sets = list(Hasher(4).sets(texts))
    assert [len(s) for s in sets] == [len(plain_set(t)) for t in texts]
    assert [len(s) for s in Hasher(4).sets(["", None, "one two"])] == [0, 0, 1] and list(Hasher(4).sets([])) == []
    all_ = {}
    for t, s in zip(["a b c d e", "b c d e f", "a b c d"], Hasher(4).sets(["a b c d e", "B C D E F", "a b c d"])):
        all_[t] = set(s.tolist())
    assert len(all_["a b c d e"] & all_["b c d e f"]) == 1 and all_["a b c d"] < all_["a b c d e"]


@pytest.mark.parametrize("rule", [*[jaccard.Rule(4, p) for p in (70, 80, 85, 95, 100)], NEAR, jaccard.Rule(4, 85, 0.5, 1.2)])
def test_linking_sets_share_a_signature(rule):
    rng = np.random.default_rng(rule.percent)
    for _ in range(300):
        n = int(rng.integers(1, 150))
        common = rng.integers(0, 1 << 63, n).astype(np.uint64)
        extra = int(rng.integers(0, n // 3 + 2))
        a = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, int(rng.integers(0, extra + 1))).astype(np.uint64)]))
        b = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, extra).astype(np.uint64)]))
        if rule.links(jaccard.overlap(a, b), len(a), len(b)):
            for common in (None, rng.random(jaccard.COUNTERS) < 0.3):
                place, signature = jaccard.signatures([a, b], rule, common)
                assert set(signature[place == 0].tolist()) & set(signature[place == 1].tolist())


def test_unlike_sets_seldom_meet():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, int(n)).astype(np.uint64) << np.uint64(1)) for n in rng.integers(12, 300, 6000)]
    place, signature = jaccard.signatures(sets, NEAR)
    meeting = {}
    for p, s in zip(place.tolist(), signature.tolist(), strict=True):
        meeting.setdefault(s, []).append(p)
    root = classes(range(len(sets)), [(m[0], x) for m in meeting.values() for x in m[1:]])
    assert max(Counter(root.values()).values()) < 60


def test_walk_loses_no_pair():
    sets = [s for s in Hasher(4).sets([t for _, t in corpus(400, 3)]) if len(s)]
    tree = jaccard.Tree(sets, 512)
    i, j = jaccard.leaf_pairs(tree, None, RULE)
    found = {*zip(i.tolist(), j.tolist())}
    want = {p for p in itertools.combinations(range(len(sets)), 2) if RULE.links(jaccard.overlap(sets[p[0]], sets[p[1]]), len(sets[p[0]]), len(sets[p[1]]))}
    assert want <= found and len(found) < len(sets) ** 2 / 8
    half = jaccard.Tree(sets[:150], 512), jaccard.Tree(sets[150:], 512)
    i, j = jaccard.leaf_pairs(*half, RULE)
    assert {p for p in want if p[0] < 150 <= p[1]} <= {*zip(i.tolist(), (j + 150).tolist())}


@pytest.mark.parametrize("sets,percent,words", [(1000, 85, 4), (5, 85, 4), (7, 80, 5)])
@pytest.mark.parametrize("shape", [{}, {"spare": 0.8, "ratio": 1.25}])
def test_equals_brute_force(spark, monkeypatch, sets, percent, words, shape):
    monkeypatch.setattr(jaccard, "TREE_SETS", sets)
    rows = corpus(500, sets)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df, StageTables(spark), jaccard.Rule(words, percent, **shape)).collect()}
    assert got == brute(rows, words, percent)


def test_query_equals_statement(spark):
    folder = "/root/testdata/sf0.01"
    difference, n = compare(QUERIES["op5_jaccard"](spark, folder), connect(folder), SQL["op5_jaccard"])
    assert difference is None and n == 1000, difference


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(60))
    rows = [(5, long), (3, long.upper()), (9, long + " more"), (1, None), (2, ""), (4, " \n"), (6, "few words"), (7, "Few\twords"), (8, "few words more"),
            (None, long), (10, "y " * 3000), (11, "y y y y"), (3, long.upper())]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_shingles, r.component_id) for r in jaccard.join(df, StageTables(spark), RULE).collect())
    assert got == [(-1, 57, None), (1, 0, 1), (2, 0, 2), (3, 57, 3), (3, 57, 3), (4, 0, 4), (5, 57, 3), (6, 1, 6), (7, 1, 6), (8, 1, 8), (9, 58, 3),
                   (10, 1, 10), (11, 1, 10)]
    assert jaccard.join(df.limit(0), StageTables(spark), RULE).count() == 0


def test_a_null_id_before_its_copies_hides_no_link(spark):
    long = " ".join(f"x{i}" for i in range(60))
    rows = [(None, long), (5, long), (None, long), (3, long.upper()), (9, long + " more"), (None, "few words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id or -1, r.component_id) for r in jaccard.join(df, StageTables(spark), RULE).collect())
    assert got == [(-1, None), (-1, None), (-1, None), (3, 3), (5, 3), (9, 3)]
    nulls = jaccard.join(df.filter("doc_id IS NULL"), StageTables(spark), RULE).collect()
    assert [r.component_id for r in nulls] == [None] * 3


class Counted(StageTables):
    """Remembers how many rows each table got."""

    def keep(self, name, df, by=None):
        out = super().keep(name, df, by)
        self.rows = getattr(self, "rows", {}) | {name: out.count()}
        return out


def test_copies_are_one_node(spark):
    """Copies in other batches meet by their content once, not by a row for each signature that they share."""
    rng = random.Random(8)
    texts = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(300)) for _ in range(4)]
    rows = [(k * 4 + i, t) for k in range(12) for i, t in enumerate(texts)]
    stage = Counted(spark)
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), stage, NEAR).collect()}
    assert got == {i: i % 4 for i, _ in rows}
    measured = sum(stage.rows.pop(x, 0) for x in ["measured"])
    assert measured <= len(rows) + 16 * 6 and max(stage.rows.values()) <= len(rows), stage.rows


def test_long_texts_that_share_a_passage_are_no_class(spark):
    rng = random.Random(9)
    word = lambda: f"v{rng.randrange(10**6)}"
    passage = [word() for _ in range(250)]
    rows = [(i, " ".join([word() for _ in range(300)] + passage + [word() for _ in range(300)])) for i in range(18)]
    rows.append((18, rows[3][1] + " " + word()))
    stage = Counted(spark)
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), stage, NEAR).collect()}
    assert got == {i: 3 if i == 18 else i for i, _ in rows}
    assert stage.rows["wanted"] == 2, stage.rows


def test_linking_sets_share_as_many_signatures_as_needed():
    rng = np.random.default_rng(4)
    for rule in (NEAR, jaccard.Rule(4, 85, 0.2, 1.5, 0.5)):
        for _ in range(200):
            n = int(rng.integers(1, 400))
            common, extra = rng.integers(0, 1 << 63, n).astype(np.uint64), int(rng.integers(0, n // 4 + 1))
            a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, x).astype(np.uint64)])) for x in (extra // 2, extra - extra // 2))
            if rule.links(jaccard.overlap(a, b), len(a), len(b)):
                place, signature, need = jaccard.signed([a, b], rule)
                held = [dict(zip(signature[place == i].tolist(), (need[place == i] & 255).tolist(), strict=True)) for i in (0, 1)]
                both = held[0].keys() & held[1].keys()
                assert both and all(held[0][s] == held[1][s] for s in both) and len(both) >= min(held[0][s] for s in both)
