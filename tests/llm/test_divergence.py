"""Sources of a language against a dense brute force, odd rows, and the statement."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from orderloom.llm import divergence
from orderloom.llm.queries import QUERIES, SQL
from orderloom.sources.stage import StageTables
from tests.conftest import SMALL
from tests.oracle_check import compare, connect

TYPES = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=10, top=10):
    docs = [(l or "", s or "", TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t, l, s in rows]
    out = []
    for lang in sorted({l for l, _, _ in docs}):
        own = [(s, ts) for l, s, ts in docs if l == lang]
        seen = Counter(t for _, ts in own for t in set(ts))
        kept = [t for t in seen if seen[t] >= least]
        counts = {s: Counter() for s, _ in own}
        for s, ts in own:
            counts[s].update(t for t in ts if seen[t] >= least)
        whole = Counter(t for c in counts.values() for t in c.elements())

        def p(c, t, v=len(kept)):
            return 1 + 1000000000 * (c[t] + 2) // (sum(c.values()) + 2 * v)

        f = lambda a, b: (a - b) ** 2 // (a + b)
        share = {s: {t: p(c, t) for t in kept} for s, c in counts.items()}
        base = {t: p(whole, t) for t in kept}
        for s in counts:
            pairs = [(sum(f(share[s][t], share[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(f(share[s][t], base[t]), t) for t in kept if counts[s][t] and share[s][t] > base[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def found(spark, rows, types=TYPES, **more):
    df = divergence.audit(spark.createDataFrame(rows, types), StageTables(spark), **more)
    return sorted(tuple(r) for r in df.collect())


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"{c}{d}" for c in "abcdefgh" for d in ("x", "Y", "é", "中", "zz")]
    rows = []
    for _ in range(n):
        source = rng.choice(["s1", "s1", "s1", "s2", "s3", None, "Ä"])
        lang = rng.choice(["en", "en", "de", None])
        own = words[: rng.randint(1, len(words))] if source != "s2" else words[20:]
        rows.append((rng.choice(["", " ", "-_", "1 2"]).join(["", *(rng.choice(own) + rng.choice([" ", ".", "9", "\x00", "\n", "@["]) for _ in range(rng.randint(0, 40)))]), lang, source))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(150, seed)
    assert found(spark, [(i, *r) for i, r in enumerate(rows)]) == brute(rows)


def test_portions_and_what_a_task_hands_out(monkeypatch):
    text = "aB cd-é ab" * 5
    monkeypatch.setattr(divergence, "PORTION_BYTES", 7)
    assert divergence.term_counts(text.encode()) == Counter(t.encode() for t in TERM.findall(text.lower()))
    rows = [(l or "", s or "", t.encode()) for t, l, s in corpus(60, 3)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 20])], ["lang", "source", "text"]) for i in (0, 20, 40)]

    def summed(held):
        monkeypatch.setattr(divergence, "HELD_TERMS", held)
        n, docs, out = Counter(), Counter(), list(divergence._count(iter(batches)))
        for r in (r for b in out for r in b.to_pylist()):
            n[r["lang"], r["source"], r["term"]] += r["n"]
            docs[r["lang"], r["source"], r["term"]] += r["docs"]
        return len(out), n, docs

    few, many = summed(3), summed(10**6)
    assert few[0] > many[0] == 1 and few[1:] == many[1:]


def test_odd_rows(spark):
    # nulls, empty texts, repeated rows, a language without kept terms, a source without terms, clashing columns
    rows = [("word " * 3, "en", "a")] * 12 + [(None, "en", None), ("", "en", ""), ("123", "xx", "b"), ("few", "xx", "c"), (None, None, None), ("w", None, "z")]
    assert found(spark, [(i, *r) for i, r in enumerate(rows)]) == brute(rows)
    types = TYPES + ", term string, place long, p double, v string"
    assert found(spark, [(None, *r, "t", 1, 2.0, "v") for r in rows], types) == brute(rows)
    assert found(spark, []) == []


def test_a_very_long_text(spark):
    rows = [("alpha beta " * 300_000, "en", "long")] + [("alpha gamma", "en", "short")] * 10 + [("beta", "en", "short")] * 10
    assert found(spark, [(i, *r) for i, r in enumerate(rows)]) == brute(rows)


def test_statement(spark):
    assert compare(QUERIES["op11_divergence"](spark, SMALL), connect(SMALL), SQL["op11_divergence"])[0] is None
