"""Each stage on its own input against a brute-force version."""

from collections import Counter

import pytest

import corpus_pipeline
from orderloom.llm import pii, stages, toxicity
from orderloom.sources.stage import StageTables
from tests.conftest import SMALL
from tests.llm.test_jaccard import brute


@pytest.fixture(scope="module")
def passed(spark):
    """Input and output of each stage by name."""
    kept, out = StageTables(spark), {}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, apply in corpus_pipeline.STAGES:
        result = kept.keep(name, apply(spark, docs, SMALL))
        out[name] = (docs, result)
        docs = result
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard", "pii", "mixing", "packing"]


def test_toxic_documents_go(spark, passed):
    before, after = passed["toxicity"]
    net = toxicity.fit(before, spark.read.parquet(f"{SMALL}/labels.parquet"))
    docs = before.collect()
    score = toxicity.Scorer(net).score([r.text for r in docs])
    assert rows(after) == Counter(tuple(r) for r, s in zip(docs, score, strict=True) if s < 0.7)
    assert after.columns == before.columns


def test_one_of_each_group_stays(passed):
    before, after = passed["jaccard"]
    group = brute([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert {r.doc_id for r in after.collect()} == {i for i, (_, root) in group.items() if i == root}
    assert not rows(after) - rows(before)


def test_personal_data_is_masked(passed):
    before, after = passed["pii"]
    spans = lambda text: [s[:3] for s in pii.judged(text) if s[3] >= pii.MASKED_AT]
    want = {r.doc_id: pii.masked(r.text, spans(r.text)) for r in before.collect()}
    assert {r.doc_id: r.text for r in after.collect()} == want
    assert all(r.n_chars == len(r.text) for r in after.collect()) and after.columns == before.columns


def test_mixed_rows_are_whole(passed):
    before, after = passed["mixing"]
    n = rows(after)
    assert set(n) <= set(rows(before)) and max(n.values()) <= 2
    words = lambda c: sum(len(r[1].split()) * k for r, k in c.items())
    assert abs(words(n) - 1.5 * words(rows(before))) < 0.05 * words(n)


def test_packed_is_all_of_the_mix(passed):
    before, after = passed["packing"]
    texts = {}
    for r in before.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    got = {}
    for r in after.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert {k: len([r for r in v if r.start == 0]) for k, v in got.items()} == {k: len(v) for k, v in texts.items()}
    once = {k: v[0] for k, v in texts.items() if len(v) == 1}
    assert sum(r.length for v in got.values() for r in v) >= sum(len(v) for v in texts.values())
    taken = {}
    for r in after.collect():
        taken.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in taken.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert once and all({r.doc_tokens for r in got[k]} == {sum(r.length for r in got[k])} for k in once)


def test_empty_and_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "one two", "en", "b", 7), (3, "x y z", "en", "a", 5), (3, "x y z", "en", "a", 5), (4, "X y z", None, "a", 5)]
    docs = spark.createDataFrame(rows, schema)
    near = stages.drop_near_copies(spark, docs, SMALL)
    assert Counter(r.doc_id for r in near.collect()) == Counter([1, 2, None, 3])
    for frame in (docs, docs.limit(0)):
        for _, apply in corpus_pipeline.STAGES:
            frame = StageTables(spark).keep("x", apply(spark, frame, SMALL))
        assert frame.columns[:3] == ["doc_id", "start", "length"]


def test_other_texts_of_a_repeated_id_stay(spark):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(7, "one thing here", "en", "a", 1), (7, "another one altogether", "en", "a", 2), (7, "", "en", "a", 3), (3, near, "en", "a", 4), (7, near + " more", "en", "a", 5),
            (8, near, "en", "a", 6), (7, "one thing here", "en", "b", 7), (None, near, "en", "a", 8), (9, "few words", "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [sorted(r.n_chars for r in stages.drop_near_copies(spark, docs.repartition(n), SMALL).collect()) for n in (1, 3, 5)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 6
    assert {2, 3, 4, 8, 9} < set(kept[0]) and len({1, 7} & set(kept[0])) == 1


ODD = [
    (1, "Some plain text of eight words or so", "en", "a", 3), (1, "Some plain text of eight words or so", "en", "a", 3), (1, "another text of the same id", None, None, 3),
    (None, "no id and a@b.example.org in it", "en", "a", 0), (None, None, None, None, None), (2, "", "de", "b", 0), (3, "   ", "de", "b", 3), (4, "long words " * 20_000, "en", "b", 1),
]
TYPES = "doc_id long, text string, lang string, source string, n_chars int"
CLASHING = {"_id": 7, "_hash": 8, "_key": "k", "_copies": 9, "_row": 1, "_node": 2, "_text": "t", "key": 5, "size": 6, "_each": 4, "spans": "s", "score": 0.5}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows_and_columns_of_any_name(spark, name, stage):
    types = TYPES + "".join(f", {n} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for n, v in CLASHING.items())
    plain = stage(spark, spark.createDataFrame(ODD, TYPES), SMALL)
    wide = stage(spark, spark.createDataFrame([(*r, *CLASHING.values()) for r in ODD], types), SMALL)
    if name == "packing":
        assert rows(wide) == rows(plain)
    else:
        assert wide.columns == [*plain.columns, *CLASHING] and dict(wide.dtypes) == {**dict(plain.dtypes), **{n: t for n, t in wide.dtypes if n in CLASHING}}
        found = wide.collect()
        assert all(tuple(r)[5:] == tuple(CLASHING.values()) for r in found)
        if name != "mixing":  # the draw goes by row, and there are two sorts of rows
            assert Counter(tuple(r)[:5] for r in found) == rows(plain)
    empty = stage(spark, spark.createDataFrame([], types), SMALL)
    assert empty.count() == 0 and empty.columns == wide.columns
