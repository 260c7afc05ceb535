"""Passages that occur twice or more anywhere in the corpus, found by seed and extend, and texts without them.

Seeds: of the seeds (short runs of words) inside each window of ``window`` words the one of smallest hash is its anchor, so
windows of the same words have the same anchor at the same place. An anchor with all windows it stands for is one row;
documents meet where anchors are alike.

Extension: two equal anchors whose whole surroundings, as far as their windows reach, are alike match over all of
these windows at once. Where the surroundings of equal anchors differ, one occurrence of each kind is extended to both
sides word by word: a window that reaches j words to the left and the rest to the right is a match of that extent, and occurs
elsewhere if another kind extends as far to both sides. Consecutive windows add up to maximal repeats, which are at
least a window long. No pairs of occurrences are made: equal rows of a portion speak through one of them, so an
anchor that stands in a third of all documents sends a row per portion and kind, and rows that meet are read as a sorted stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import slices
from orderloom.llm.shingles import mix
from orderloom.llm.words import WordHasher, joined
from orderloom.sources.stage import StageTables

WINDOW, SEED = 35, 12
PORTION_BYTES = 4 << 20  # bytes of text whose occurrences speak through one row
STRETCH = 1 << 19  # windows that are worked out at once
BLANKS = b" \t\n\x0b\x0c\r"
_BLANK = bytes(0x20 if c in BLANKS else c for c in range(256))
_SPAN, _SEED = 0, 1  # kinds of rows: known repeats, occurrences that look for others
_NAMES = ["kind", "home", "h", "cls", "a", "b", "x", "c", "off", "told"]
_TYPES = "kind int, home long, h long, cls long, a long, b long, x long, c long, off long, told boolean"
AT_HOME = 32  # kinds of one anchor that a portion sends to the anchor's own partition; it deals out the rest by kind
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


class Runs:
    """Hashes of any runs of one sequence of words."""

    def __init__(self, word: np.ndarray):
        n = len(word) + 1
        self.power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
        self.inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(word * self.power[: n - 1])])

    def hash(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.inverse[start] + np.asarray(length).astype(np.uint64))


def seeds(word: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; words count other than in ``Runs``, so the two are independent."""
    own, out = mix(word ^ np.uint64(0xA0761D6478BD642F)), np.zeros(max(0, len(word) - size + 1), np.uint64)
    for j in range(size):
        out = mix(out + own[j : j + len(out)])
    return out


def anchors(seed: np.ndarray, reach: int) -> np.ndarray:
    """Place of the smallest of the ``reach`` seeds from each on, the last of equal ones."""
    n = len(seed) - reach + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    value, place, width = seed, np.arange(len(seed)), 1

    def merge(step):
        left, right = value[: len(value) - step], value[step:]
        later = right <= left
        return np.where(later, right, left), np.where(later, place[step:], place[: len(place) - step])

    while 2 * width <= reach:
        value, place = merge(width)
        width *= 2
    if width < reach:
        value, place = merge(reach - width)
    return place[:n]


def occurrences(word: np.ndarray, ends: np.ndarray, window: int, seed: int, stretch: int = STRETCH) -> Iterator[dict[str, np.ndarray]]:
    """Anchors of a sequence of texts that end at ``ends``: h, cls (their surroundings), text, x (first window, in the text), c windows, off."""
    begin = np.concatenate([[0], ends[:-1]])
    for at in range(0, len(word), stretch):
        some = word[at : at + stretch + window - 1]
        grams = seeds(some, seed)
        place = anchors(grams, window - seed + 1)
        if not len(place):
            return
        text = np.searchsorted(ends, at + np.arange(len(place)), side="right")
        inside = at + np.arange(len(place)) + window <= ends[text]
        x, place, text = np.flatnonzero(inside), place[inside], text[inside]
        if not len(x):
            continue
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
        count = np.diff(np.append(first, len(x)))
        x, place, text = x[first], place[first], text[first]
        off = place - x
        around = Runs(some).hash(x, count + window - 1)
        yield {
            "h": grams[place], "cls": mix(around ^ mix((off * window + count).astype(np.uint64))), "text": text,
            "x": x + at - begin[text], "c": count, "off": off,
        }


def _out(kind: int, home, h, cls, a, b, x, c, off, told) -> pa.RecordBatch:
    whole = [np.full(len(a), kind, np.int32), home.view(np.int64), h.view(np.int64), cls.view(np.int64), a, b, x, c, off, told]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v)) for v in whole], _NAMES)


def _spans(a, b, x, c) -> pa.RecordBatch:
    """Known repeats; windows that follow each other in a text are one row."""
    order = np.lexsort((x, b, a))
    a, b, x, c = a[order], b[order], x[order], c[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (x[1:] != x[:-1] + c[:-1])
    head = np.flatnonzero(fresh)
    none = np.zeros(len(head), np.uint64)
    return _out(_SPAN, mix(b[head].view(np.uint64) + x[head].astype(np.uint64)), none, none, a[head], b[head], x[head], np.add.reduceat(c, head) if len(head) else c[head], head * 0, head < 0)


def _speak(h, cls, a, b, x, c, off, told, at_home: int) -> Iterator[pa.RecordBatch]:
    """Occurrences of a portion: those alike in it are known repeats, and one of them goes on to look for others.

    An anchor of very many kinds would fill one partition. Its kinds beyond the first few go where their own hash says; they
    are known to have others beside them, and the first few tell that to single kinds of other portions.
    """
    if not len(h):
        return
    order = np.lexsort((told, cls, h))
    h, cls, a, b, x, c, off, told = (v[order] for v in (h, cls, a, b, x, c, off, told))
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])])
    head = np.flatnonzero(fresh)
    size = np.diff(np.append(head, len(h)))
    known = np.logical_or.reduceat(told, head) | (size > 1)
    tell = known[np.cumsum(fresh) - 1] & ~told
    yield _spans(a[tell], b[tell], x[tell], c[tell])
    same = np.concatenate([[True], h[head][1:] != h[head][:-1]])
    nth = np.arange(len(head)) - np.flatnonzero(same)[np.cumsum(same) - 1]
    home = np.where(nth < at_home, h[head], mix(h[head] ^ mix(cls[head])))
    yield _out(_SEED, home, h[head], cls[head], a[head], b[head], x[head], c[head], off[head], known)


def _plant(window: int, seed: int):
    """Seed rows of texts (a, b, text)."""
    portion, stretch, at_home = PORTION_BYTES, STRETCH, AT_HOME

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(BLANKS)
        for part in (p for whole in batches for p in slices(whole, 2, portion)):
            a, b = part.column(0).to_numpy(), part.column(1).to_numpy()
            data, edges = joined(part.column(2).to_pylist(), hasher.mark)
            word, first, _ = hasher.words(data)
            ends = np.searchsorted(first, edges[1:])
            found = list(occurrences(word, ends, window, seed, stretch))
            if found:
                h, cls, text, x, c, off = (np.concatenate([f[n] for f in found]) for n in ("h", "cls", "text", "x", "c", "off"))
                yield from _speak(h, cls, a[text], b[text], x, c, off, np.zeros(len(h), bool), at_home)

    return run


def _meet(seek: bool):
    """Rows sorted by (h, cls): occurrences of the same h and cls are repeats; ``seek`` also passes on one of each cls where an h has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, told_on, several = None, False, False, False  # the last cls: its first row, and what is known of it
        for batch in batches:
            kind = batch.column(0).to_numpy()
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            if (kind == _SPAN).any():
                yield batch.filter(pa.array(kind == _SPAN))
            rows = [r[kind == _SEED] for r in rows]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.concatenate([o, r]) for o, r in zip(held, rows, strict=True)]
            home, h, cls, a, b, x, c, off, told = rows
            group = np.concatenate([[True], h[1:] != h[:-1]])
            fresh = group | np.concatenate([[True], cls[1:] != cls[:-1]])
            head = np.flatnonzero(fresh)
            number = np.cumsum(fresh) - 1
            repeat = np.logical_or.reduceat(told, head) | (np.diff(np.append(head, len(h))) > 1)
            repeat[0] |= known
            tell = repeat[number] & ~told
            tell[0] &= not told_on
            if tell.any():
                yield _spans(a[tell], b[tell], x[tell], c[tell])
            of = np.cumsum(group)[head] - 1  # the group of each cls
            many = (np.bincount(of) > 1) | np.logical_or.reduceat(home != h, np.flatnonzero(group))
            many[0] |= several
            last = head[-1]
            if seek:
                ask = np.flatnonzero(many[of])
                ask = ask[ask < len(head) - 1]
                if len(ask):
                    at = head[ask]
                    yield _out(_SEED, h[at], h[at], cls[at], a[at], b[at], x[at], c[at], off[at], repeat[ask])
            held = [r[last : last + 1] for r in rows]
            told_on, known, several = bool(tell[last] or (last == 0 and told_on)), bool(repeat[-1]), bool(many[of[-1]])
        if seek and held is not None and several:
            yield _out(_SEED, *held[:8], np.array([known]))

    return run


def _extend(window: int):
    """Each window of the occurrences asked for (a, b, text, asked), as a row that looks for its like."""
    portion, stretch, at_home = PORTION_BYTES, STRETCH, AT_HOME

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(BLANKS)
        for part in (p for whole in batches for p in slices(whole, 2, portion)):
            asked = part.column(3)
            sizes = asked.value_lengths().to_numpy()
            x, c, off, h, told = (asked.flatten().field(n).to_numpy(zero_copy_only=False) for n in ("x", "c", "off", "h", "told"))
            text = np.repeat(np.arange(part.num_rows), sizes)
            data, edges = joined(part.column(2).to_pylist(), hasher.mark)
            word, first, _ = hasher.words(data)
            begin = np.searchsorted(first, edges[:-1])
            runs = Runs(word)
            for at in np.split(np.arange(len(x)), np.flatnonzero(np.diff(np.cumsum(c) // stretch)) + 1):
                each = np.repeat(at, c[at])
                step = np.arange(len(each)) - np.repeat(np.cumsum(c[at]) - c[at], c[at])
                start, own = x[each] + step, text[each]
                key = mix(h[each].view(np.uint64) ^ mix((off[each] - step).astype(np.uint64) + np.uint64(1)))
                yield from _speak(
                    key, runs.hash(begin[own] + start, window), part.column(0).to_numpy()[own], part.column(1).to_numpy()[own],
                    start, np.ones(len(each), np.int64), np.zeros(len(each), np.int64), told[each], at_home,
                )

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """(a, b, doc_id, text as bytes): rows of equal a and b have the same id and text, and so the same repeats."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text")).select(
        F.coalesce("doc_id", F.lit(0)).alias("a"), F.xxhash64(F.col("doc_id").isNull(), "_text").alias("b"), "doc_id", F.col("_text").cast("binary").alias("text"),
    )


def _per_text(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows of each text as one list, no longer than the text. Joined by shuffling unless Spark's own size check finds it small."""
    return rows.groupBy("a", "b").agg(F.collect_list(F.struct(*columns)).alias("rows"))


def repeats(docs: DataFrame, stage: StageTables, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Rows (a, b, x, c): in the texts of key (a, b) each of the c windows from word x on occurs anywhere else too."""
    if not 0 < seed <= window:
        raise ValueError("a seed has at least one word and fits into the window")
    keyed = _keyed(docs)
    met = keyed.select("a", "b", "text").mapInArrow(_plant(window, seed), _TYPES).repartition("home").sortWithinPartitions("h", "cls")
    met = stage.keep("met", met.mapInArrow(_meet(True), _TYPES))
    asked = met.filter(F.col("kind") == _SEED)
    lists = _per_text(asked, "x", "c", "off", "h", "told")
    extended = keyed.select("a", "b", "text").join(lists, ["a", "b"]).select("a", "b", "text", "rows").mapInArrow(_extend(window), _TYPES)
    extended = extended.repartition("home").sortWithinPartitions("h", "cls").mapInArrow(_meet(False), _TYPES)
    extended = stage.keep("extended", extended)
    return met.filter(F.col("kind") == _SPAN).select("a", "b", "x", "c").union(extended.filter(F.col("kind") == _SPAN).select("a", "b", "x", "c"))


def _without(window: int):
    """Texts (doc_id, text, rows) without the words of their repeats."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(data: bytes, rows: list[dict]) -> tuple[bytes, int, int, list[dict]]:
        spans: list[list[int]] = []
        for start, end in sorted((r["x"], r["x"] + r["c"] + window - 1) for r in rows):
            if spans and start <= spans[-1][1]:
                spans[-1][1] = max(end, spans[-1][1])
            else:
                spans.append([start, end])
        flat, kept, n, at, nth = data.translate(_BLANK), [], 0, 0, 0
        while at < len(flat):  # some words at a time
            to = flat.find(b" ", at + PORTION_BYTES)
            to = len(flat) if to < 0 else to
            words, done = flat[at:to].split(), 0
            while nth < len(spans) and spans[nth][0] < n + len(words):
                kept += words[done : max(done, spans[nth][0] - n)]
                done = min(len(words), spans[nth][1] - n)
                if spans[nth][1] > n + len(words):
                    break
                nth += 1
            kept += words[done:]
            n, at = n + len(words), to
        return b" ".join(kept), n, sum(e - s for s, e in spans), [{"start": s, "end": e} for s, e in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in slices(whole, 1, PORTION_BYTES)):
            done = [cut(text, rows or []) for text, rows in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            kept, n, gone, spans = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(kept, pa.binary()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind)],
                ["doc_id", "kept", "n_words", "n_removed", "spans"],
            )

    return run


def remove(docs: DataFrame, stage: StageTables, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, kept (the words left, joined by one space), n_words, n_removed, spans (removed words, end exclusive).

    A null text has no words, and a text of fewer words than a window keeps all. Rows that repeat an id and its text are
    occurrences of their own, so a repeated text of a window or more loses all its words. Null ids keep their rows. Only doc_id and text are
    read, so other columns cannot clash. An empty table gives an empty result.
    """
    lists = _per_text(stage.keep("repeats", repeats(docs, stage, window, seed).distinct()), "x", "c")
    joined_rows = _keyed(docs).join(lists, ["a", "b"], "left").select("doc_id", "text", "rows")
    out = joined_rows.mapInArrow(_without(window), "doc_id long, kept binary, n_words long, n_removed long, spans array<struct<start:long,end:long>>")
    return out.withColumn("kept", F.col("kept").cast("string"))


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
