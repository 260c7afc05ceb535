"""Held-out accuracy, the table look-up against the plain network, odd rows."""

import zlib

import numpy as np
import pytest

from orderloom.llm import language
from orderloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def plain(net, text):
    """The network as written down: one-hot bytes, filters, maxima, softmax, windows weighed by bytes."""
    data, total, weight = text.encode(), np.zeros(len(net.languages)), 0
    for at in range(0, len(data), language.WINDOW):
        own = data[at : at + language.WINDOW + 3]
        own = own + bytes(language.WINDOW + 3 - len(own))
        z = [sum(net.tables[j][own[t + j]] for j in range(4)) for t in range(language.WINDOW)]
        logits = np.maximum(np.max(z, 0) + net.bias, 0) @ net.weight + net.offset
        n = min(language.WINDOW, len(data) - at)
        total += n * (logits - np.log(np.exp(logits - logits.max()).sum()) - logits.max())
        weight += n
    p = np.exp(total / weight)
    return p / p.sum()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def net(docs):
    return language.fit(docs, rows=150)


def test_tables_equal_the_plain_network(net):
    texts = ["Das ist ein kurzer Text.", "é" * 300, "One two three. " * 40, "x"]
    names, scores = language.Reader(net).score(texts)
    for text, name, score in zip(texts, names, scores, strict=True):
        p = plain(net, text)
        assert abs(p.max() - score) < 0.02 and (name == net.languages[p.argmax()] or np.ptp(np.sort(p)[-2:]) < 0.02)


def test_held_out_accuracy(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op9_language"](spark, FOLDER).collect()}
    true = {r.doc_id: r.lang for r in docs.collect()}
    assert set(got) == set(true)
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    held = [k for k, r in got.items() if r.held_out and true[k]]
    assert len(held) > 150 and np.mean([got[k].lang_pred == true[k] for k in held]) > 0.97


def test_whole_text_counts(net):
    text = "Der erste Teil ist deutsch. " * 2
    one, _ = language.Reader(net).score([text])
    other, _ = language.Reader(net).score([text + "the and of that with for was " * 400])
    assert one != other


def test_odd_rows(spark, net):
    rows = [(1, None, "a"), (2, "", "b"), (3, "12 34 --", "c"), (None, "the of and", None), (4, "the of and", "x"), (4, "the of and", "x")]
    out = language.predict(spark.createDataFrame(rows, "doc_id long, text string, score string"), net).collect()
    assert len(out) == 6
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in out if r.doc_id in (1, 2, 3))
    assert all(r.lang_pred in net.languages for r in out if r.doc_id in (4, None))
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.predict(empty, language.fit(empty)).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.predict(unlabelled, language.fit(unlabelled)).collect()] == ["und"]
