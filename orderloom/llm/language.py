"""Language of texts by a convolutional network over bytes, trained in numpy.

Filters of widths 2 to 4 slide over the bytes of fixed-length windows, each filter keeps its largest value of
a window, and a softmax over these maxima names the language. All windows of a text count, weighed by
their bytes. A filter over bytes is a table per place, so two bytes at a time are looked up in whole-number
tables: a window costs two look-ups per byte, whatever the widths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import TEXT_BYTES, id_remainder, slices

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS_EACH = 12
TRAIN_ROWS = 600  # labelled rows per language, at most
TRAIN_CHARS = 1500  # characters taken from each of them
TRAIN_WINDOWS = 24_000
EPOCHS, BATCH, RATE = 4, 256, 0.02
UNKNOWN = "und"
_POSITIONS = 1 << 17  # looked up at a time
_LETTER = re.compile(r"[^\W\d_]")
_REACH = max(WIDTHS)


@dataclass
class ByteNet:
    """tables: place x byte x filter; bias: filter; weight, offset: of the softmax."""

    languages: list[str]
    tables: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: np.ndarray


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other; per window its place in them, its text and its bytes.

    A text fills whole windows and the reach of the widest filter after them with zeros.
    """
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], np.int64)
    room = counts * WINDOW + _REACH - 1
    starts = np.cumsum(room) - room
    flat = np.zeros(room.sum(), np.uint8)
    for start, t in zip(starts.tolist(), texts, strict=True):
        flat[start : start + len(t)] = np.frombuffer(t, np.uint8)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    owner = np.repeat(np.arange(len(texts)), counts)
    sizes = np.minimum(WINDOW, np.array([len(t) for t in texts])[owner] - nth * WINDOW)
    return flat, starts[owner] + nth * WINDOW, owner, sizes


_LOOK = np.arange(WINDOW + _REACH - 1)


def _filters() -> np.ndarray:
    """place x filter: 1 where a filter of its width looks."""
    return np.concatenate([np.repeat(np.arange(_REACH)[:, None] < w, FILTERS_EACH, 1) for w in WIDTHS], 1).astype(np.float32)


def train(texts: list[str], labels: list[str], seed: int = 7) -> ByteNet:
    """Fit the network on windows of ``texts`` by Adam; only the winning place of each filter has a gradient."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    target = np.array([languages.index(x) for x in labels])
    flat, begins, owner, sizes = windows_of([t.encode() for t in texts])
    pick = rng.permutation(np.flatnonzero(sizes >= WINDOW // 10))[:TRAIN_WINDOWS]
    rows, y = flat[begins[pick, None] + _LOOK], target[owner[pick]]
    mask = _filters()
    f, k = mask.shape[1], len(languages)
    net = ByteNet(
        languages, (rng.normal(0, 0.3, (_REACH, 256, f)) * mask[:, None, :]).astype(np.float32), np.zeros(f, np.float32),
        rng.normal(0, 0.3, (f, k)).astype(np.float32), np.zeros(k, np.float32),
    )
    values = [net.tables, net.bias, net.weight, net.offset]
    first, second, turn = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    balance = len(y) / (k * np.maximum(1, np.bincount(y, minlength=k)))
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            x, n = rows[own], len(own)
            z = sum(net.tables[j][x[:, j : j + WINDOW]] for j in range(_REACH)) + net.bias
            best = z.argmax(1)
            top = np.maximum(np.take_along_axis(z, best[:, None, :], 1)[:, 0], 0)
            logits = top @ net.weight + net.offset
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), y[own]] -= 1
            p *= (balance[y[own]] / n)[:, None]
            up = (p @ net.weight.T) * (top > 0)
            tables = np.zeros_like(net.tables)
            for j in range(_REACH):
                np.add.at(tables[j], (x[np.arange(n)[:, None], best + j], np.arange(f)[None, :]), up)
            turn += 1
            for v, g, a, b in zip(values, (tables * mask[:, None, :], up.sum(0), top.T @ p, p.sum(0)), first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                v -= (RATE / (1 - 0.9**turn)) * a / (np.sqrt(b / (1 - 0.999**turn)) + 1e-7)
    return net


class Reader:
    """The network as whole-number tables over pairs of bytes, ready to score texts."""

    def __init__(self, net: ByteNet):
        self.net = net
        self.scale = 16000.0 / max(1e-6, float(np.abs(net.tables).max(1).sum(0).max()))
        whole = np.round(net.tables * self.scale).astype(np.int16)
        pair = lambda a, b: (whole[a][None, :, :] + whole[b][:, None, :]).reshape(65536, -1)  # noqa: E731  low byte first
        self.ahead, self.behind = pair(0, 1), pair(2, 3)

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its probability per text; unknown with 0 where there is no letter."""
        net = self.net
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if net.languages else []
        if not known:
            return names, scores
        flat, begins, owner, sizes = windows_of([texts[i].encode() for i in known])
        total, weight = np.zeros((len(known), len(net.languages))), np.zeros(len(known))
        step = max(1, _POSITIONS // WINDOW)
        for at in range(0, len(begins), step):
            x = flat[begins[at : at + step, None] + _LOOK].astype(np.uint16)
            pairs = x[:, :-1] | (x[:, 1:] << 8)
            top = (self.ahead[pairs[:, :WINDOW]] + self.behind[pairs[:, 2 : 2 + WINDOW]]).max(1)
            logits = np.maximum(top / self.scale + net.bias, 0) @ net.weight + net.offset
            logits -= logits.max(1, keepdims=True)
            logits -= np.log(np.exp(logits).sum(1, keepdims=True))
            w = sizes[at : at + step].astype(float)
            np.add.at(total, owner[at : at + step], logits * w[:, None])
            np.add.at(weight, owner[at : at + step], w)
        mean = total / np.maximum(1.0, weight)[:, None]
        mean -= mean.max(1, keepdims=True)
        p = np.exp(mean) / np.exp(mean).sum(1, keepdims=True)
        for i, place, best in zip(known, range(len(known)), p.argmax(1).tolist(), strict=True):
            names[i], scores[i] = net.languages[best], float(min(1.0, p[place, best]))
        return names, scores


def sample(docs: DataFrame, fold: int = 2, divisor: int = 4, rows: int = TRAIN_ROWS) -> list[tuple[str, str]]:
    """At most ``rows`` labelled texts (a stretch of each) per language, outside the held-out fold, chosen by a hash of the id."""
    labelled = docs.select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("doc_id").cast("long")).alias("key"), id_remainder("doc_id", divisor).alias("fold"),
    ).filter((F.col("fold") != fold) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    # a share per language that yields about 1.3 times the rows wanted; the rest is cut by the hash below
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.3 * rows / n))]), F.col("lang"))
    begin = (F.pmod("key", F.greatest(F.length("text") - TRAIN_CHARS, F.lit(1))) + 1).cast("int")
    drawn = labelled.filter(F.pmod(F.col("key"), F.lit(1 << 30)) < share * (1 << 30))
    found = drawn.select("lang", "key", F.substring("text", begin, F.lit(TRAIN_CHARS)).alias("text")).collect()
    taken: dict[str, int] = {}
    out = []
    for row in sorted(found, key=lambda r: (r["key"], r["text"])):
        taken[row["lang"]] = taken.get(row["lang"], 0) + 1
        if taken[row["lang"]] <= rows:
            out.append((row["text"], row["lang"]))
    return out


def fit(docs: DataFrame, **how) -> ByteNet:
    """Train on a bounded sample; without labelled rows the network knows no language."""
    pairs = sample(docs, **how)
    if not pairs:
        return ByteNet([], np.zeros((_REACH, 256, 1), np.float32), np.zeros(1), np.zeros((1, 0)), np.zeros(0))
    return train([t for t, _ in pairs], [lang for _, lang in pairs])


def predict(docs: DataFrame, net: ByteNet) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, from the whole text alone.

    A null or empty text, and one without a letter, is ``und`` with score 0; so is every text when no label was
    there to learn from. Null ids are not held out. Repeated rows are kept, other columns not read, and an empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # its size is set by the filters, not by the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for b in (p for whole in batches for p in slices(whole, 2, TEXT_BYTES)):
            names, scores = reader.score(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (id_remainder("doc_id", 4) == 2).alias("held_out"), F.col("text").cast("string").alias("text"),
    )
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
