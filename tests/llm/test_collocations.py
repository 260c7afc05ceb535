"""Phrases against brute force: flows, paths, split words, long pieces, odd rows, the statement."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from orderloom.llm import collocations
from orderloom.llm.queries import QUERIES, SQL
from orderloom.sources.stage import StageTables
from tests.conftest import SMALL
from tests.oracle_check import compare, connect

TYPES = "doc_id long, text string, lang string"


def grams(rows):
    out = Counter()
    for text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            out.update((lang or "und", tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    return out


def brute(rows, least=10, cover=50, top=2000):
    f, out = grams(rows), {}
    long = Counter()
    for (lang, g), a in f.items():
        if len(g) == 3 and a >= least:
            for part in (g[:2], g[1:]):
                long[lang, part] = max(long[lang, part], a)
    for (lang, g), a in f.items():
        if len(g) > 1 and a >= least and not (len(g) == 2 and long[lang, g] and 100 * long[lang, g] >= cover * a):
            s, k = min((1000000 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
            out.setdefault(lang, []).append((-s, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    n = Counter()
    for (lang, g), c in f.items():
        n[lang] += c * (len(g) == 1)
    return sorted(
        (lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)
    )


def found(spark, rows, types=TYPES, **more):
    return sorted(tuple(r) for r in collocations.phrases(spark.createDataFrame(rows, types).repartition(4), StageTables(spark), **more).collect())


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "中文", "x9", "-", "don't", "\x00", "a(b)", "ß", "q"]
    passage = " ".join(f"p{i}" for i in range(30))
    rows = []
    for _ in range(n):
        own = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " \x0b"]) for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.3:
            own += " " + passage[: rng.choice([40, 200])] + rng.choice(["", " end", "."])
        rows.append((own, rng.choice(["en", "en", "de", None, "und", "a b\nc"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(200, seed)
    assert found(spark, [(i, *r) for i, r in enumerate(rows)]) == brute(rows)


@pytest.mark.parametrize("least, cover, top", [(1, 50, 10**6), (3, 100, 7), (2, 101, 40)])
def test_other_bounds(spark, least, cover, top):
    rows = corpus(40, least)
    assert found(spark, [(i, *r) for i, r in enumerate(rows)], least=least, cover=cover, top=top) == brute(rows, least, cover, top)


def test_split_words_and_pairs(spark, monkeypatch):
    # nearly every word and pair is dealt finer, so that flows are summed from parts
    rows = corpus(150, 5)
    want = brute(rows)
    for split, slots in ((0, 4), (3, 1 << 18)):
        monkeypatch.setattr(collocations, "LEAST_SPLIT", split)
        monkeypatch.setattr(collocations, "hot_slots", lambda docs, s=split, n=slots: collocations.np.ones((2, collocations.SLOTS), bool) if not s else hot(docs, n))
        assert found(spark, [(i, *r) for i, r in enumerate(rows)]) == want


def hot(docs, n):
    out = collocations.np.zeros((2, collocations.SLOTS), bool)
    out[0] = True
    out[1, ::2] = True
    return out


def test_counters_tell_hot_words(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_SPLIT", 100)
    texts = spark.createDataFrame([("en", b"the cat. the dog " * 60 + b"rare words"), ("en", b"")], "lang string, text binary")
    slots = collocations.hot_slots(texts)
    assert slots[0].sum() == 1 and slots[1].sum() == 0


def test_flow_in_small_batches(spark, monkeypatch):
    rows = corpus(60, 7)
    # read when the functions go to the workers; with so few bits many edges share a spot
    for name, value in (("STEP_ROWS", 5), ("_HOME_BITS", 3), ("_PAIR_BITS", 1)):
        monkeypatch.setattr(collocations, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert found(spark, [(i, *r) for i, r in enumerate(rows)]) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_task_hands_out_often():
    rows = corpus(60, 8)
    batch = pa.RecordBatch.from_arrays([pa.array([l or "und" for _, l in rows]), pa.array([t.encode() for t, _ in rows])], ["lang", "text"])
    sums = []
    for held in (5, 10**6):
        bits = collocations.np.packbits(collocations.np.zeros((2, collocations.SLOTS), bool)).tobytes()
        out = list(collocations._edges(bits, held)(iter([batch])))
        sums.append(Counter())
        for r in (r for b in out for r in b.to_pylist()):
            sums[-1][r["gram"], r["spot"]] += r["n"]
    assert sums[0] == sums[1] and len(sums[0])


def test_long_pieces_share_words(monkeypatch):
    text = " ".join(f"w{i % 7}" for i in range(400)).encode() + b" \t "
    want = Counter(collocations.edges_of(text))
    monkeypatch.setattr(collocations, "PORTION_BYTES", 11)
    assert Counter(collocations.edges_of(text)) == want and sum(want.values()) == 398 + 2


def test_paths_hold_long_passages(spark):
    text = "start " + " ".join(f"p{i}" for i in range(50))
    df = spark.createDataFrame([(i, f"{'abc'[i % 3]} {text} {'xyz'[i % 3]}", "en") for i in range(30)], TYPES)
    stage = StageTables(spark)
    edges, pairs, words = collocations.graph(df, stage)
    rows = collocations.paths(edges, stage.keep("pairs", pairs), stage).collect()
    longest = max(rows, key=lambda r: len(r.w))
    assert " ".join(longest.w) == text and longest.n == 30 and edges.count() > 40
    assert found(spark, df.collect()) == brute([(r.text, r.lang) for r in df.collect()])


def test_odd_rows(spark):
    rows = [(None, "en"), ("", None), (" ,. ", "de"), ("one", "de"), ("Big Deal", None)] + [("big deal", "und")] * 10 + [("a b c", "en")] * 10
    assert found(spark, [(i, *r) for i, r in enumerate(rows)]) == brute(rows)
    more = [(None, *r, b"g", 1, ["w"], 2) for r in rows]
    assert found(spark, more, TYPES + ", gram binary, n int, w array<string>, kind int") == brute(rows)
    assert found(spark, []) == []


def test_a_very_long_text(spark):
    rows = [("alpha beta gamma " * 400_000, "en"), ("alpha beta. " * 20, "en")]
    assert found(spark, [(i, *r) for i, r in enumerate(rows)]) == brute(rows)


def test_products_beyond_64_bits(spark):
    row = spark.sql(f"SELECT {collocations.score('a', 'l', 'r')} AS s FROM VALUES (3000000000000L, 4000000000000L, 5000000000000L) t(a, l, r)").first()
    assert row.s == 10**6 * (3 * 10**12) ** 2 // (4 * 10**12 * 5 * 10**12)


def test_statement(spark):
    assert compare(QUERIES["op12_collocations"](spark, SMALL), connect(SMALL), SQL["op12_collocations"])[0] is None
