"""Phrases whose words keep together, from a weighted de Bruijn graph of the corpus.

Nodes are pairs of neighbouring words, edges triples, and an edge's weight is the number of its occurrences. Only edges are
counted in the texts; a piece that ends adds an edge to the end from its last pair and one from its last word. All
shorter counts are flows: a pair occurs as often as edges leave it (the end included), a word as often as pairs that begin with
it, and ends.

Edges below the least count cannot be candidates and serve as flow alone. What is left is compacted: a pair that one
edge enters and one edge leaves, with the same weight and nothing else, is inside a path, so a path is one row whose pairs all occur
as often as the path. Such inner pairs are covered by the longer phrases around them; scores need the counts of a path's
two outer pairs only.

An edge is dealt by its first word, so most words are summed where they lie. First words and pairs that hold a large share of
the corpus, which a fixed number of counters tells, are dealt by pair or by edge instead, and their partial flows summed.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm.common import slices
from orderloom.llm.shingles import mix
from orderloom.llm.words import WordHasher, joined
from orderloom.sources.stage import StageTables

LEAST = 10
COVER = 50  # per cent of a phrase's occurrences that a longer one may hold before it is dropped
TOP = 2000
SCALE = 1_000_000
HELD_EDGES = 400_000  # different edges that a task adds up before it hands them out
PORTION_BYTES = 4 << 20
SLOTS = 1 << 18  # counters of words and as many of pairs
LEAST_SPLIT = 100_000  # occurrences; a counter above that, and above four times the mean, is dealt finer
_TABLE = bytes(0x0A if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c in b" \t" else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_WORD, _PAIR, _EDGE = 1, 2, 3  # kinds of rows, by their words; also how an edge was dealt, in the last bits of its spot
_HOME_BITS, _PAIR_BITS = 24, 16
STEP_ROWS = 50_000


def pieces(text: bytes) -> Iterator[tuple[list[bytes], bool]]:
    """Words of the pieces of a text, and whether the piece ends with them; a very long piece comes in parts that share two words."""
    flat, at = text.translate(_TABLE), 0
    while at < len(flat):
        to = flat.find(b"\n", at + PORTION_BYTES)
        to = len(flat) if to < 0 else to
        for piece in flat[at:to].split(b"\n"):
            if len(piece) <= PORTION_BYTES:
                yield piece.split(), True
                continue
            begin, words = 0, []
            while begin < len(piece):
                end = piece.find(b" ", begin + PORTION_BYTES)
                end = len(piece) if end < 0 else end
                words = [*words[-2:], *piece[begin:end].split()]
                yield words, end == len(piece)
                begin = end
        at = to


def edges_of(text: bytes) -> Iterator[bytes]:
    """Edges of a text as three words with blanks between them; the end is an empty word."""
    for words, whole in pieces(text):
        yield from map(b" ".join, zip(words, words[1:], words[2:], strict=False))
        if whole and words:
            if len(words) > 1:
                yield b"%b %b " % (words[-2], words[-1])
            yield b"%b  " % words[-1]


def hot_slots(docs: DataFrame) -> np.ndarray:
    """For words and for pairs, which counters hold so much that their edges are dealt finer. Counters are summed in two steps."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = WordHasher(b" \n"), np.zeros((2, SLOTS), np.int64)
        for part in (p for whole in batches for p in slices(whole, 1, PORTION_BYTES)):
            data, _ = joined(part.column(1).to_pylist(), b"\n")
            word, _, _ = hasher.words(data.translate(_TABLE))
            for row, key in zip(counts, (word, pair_hash(word[:-1], word[1:])), strict=True):
                row += np.bincount((key & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 64]), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], ["share", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in table.column("counts").to_pylist())
        return pa.table([table.column("share")[:1], pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["share", "counts"])

    types = "share long, counts binary"
    summed = docs.select("lang", "text").mapInArrow(count, types).groupBy("share").applyInArrow(add, types)
    rows = summed.withColumn("share", F.lit(0).cast("long")).groupBy("share").applyInArrow(add, types).collect()  # one row
    if not rows:
        return np.zeros((2, SLOTS), bool)
    counts = np.frombuffer(zlib.decompress(rows[0]["counts"]), np.int64).reshape(2, SLOTS)
    return counts > np.maximum(LEAST_SPLIT, 4 * counts.mean(1))[:, None]


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b))


def blanks_of(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per edge (in ``flat``, between two ``offsets``) the places of its last blank but one and of its last one."""
    at = np.flatnonzero(flat[: offsets[-1]] == 0x20)
    last = np.searchsorted(at, offsets[1:]) - 1
    return at[last - 1], at[last]


def _edges(hot_bits: bytes, held_edges: int):
    """Rows (spot, gram, n) of texts (lang, text): the edges of a task's texts, behind their language and a line feed.

    ``spot`` is where an edge goes: few bits of its first word, then few of its pair, then how it is dealt. An edge that is dealt by its
    pair or as a whole has bits of these in the first word's place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.unpackbits(np.frombuffer(hot_bits, np.uint8)).astype(bool).reshape(2, SLOTS)
        hasher, held = WordHasher(b" \n"), {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                front = lang.encode() + b"\n"
                grams = pa.array([front + g for g in counts], pa.binary())
                offsets = np.frombuffer(grams.buffers()[1], np.int32)[: len(grams) + 1].astype(np.int64)
                flat = np.frombuffer(grams.buffers()[2], np.uint8)
                one, two = blanks_of(flat, offsets)
                begins = [offsets[:-1] + len(front), one + 1, two + 1]
                first, second, third = hasher.between(flat, begins, [one, two, offsets[1:]])
                pair = pair_hash(first, second)
                fine = hot[0][(first & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64)
                finest = fine * hot[1][(pair & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64)
                home = np.where(finest > 0, pair_hash(pair, third), np.where(fine > 0, pair, first)) >> np.uint64(64 - _HOME_BITS)
                near = (pair & np.uint64((1 << _PAIR_BITS) - 1)) << np.uint64(2)
                spot = (home << np.uint64(_PAIR_BITS + 2)) | near | (np.uint64(_WORD) + fine + finest)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(spot.view(np.int64)), grams, pa.array(np.fromiter(counts.values(), np.int64, len(counts)))], ["spot", "gram", "n"]
                )
            held.clear()

        for part in (p for whole in batches for p in slices(whole, 1, PORTION_BYTES)):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found = edges_of(text)
                while some := list(itertools.islice(found, held_edges)):
                    held.setdefault(lang, Counter()).update(some)
                    if sum(map(len, held.values())) > held_edges:
                        yield from out()
        yield from out()

    return run


def _flow(least: int):
    """Edges in order of their spots: rows (kind, gram, n) of edges of ``least`` or more, of pairs that may have as many, and of all words.

    Equal edges have the same spot, and so have all edges of a pair unless it was dealt finer; other edges may share it. Rows of one spot are
    summed together. Sums of a word, and of a pair that was dealt finer, are parts of theirs.
    """

    def rows(kind: int, grams: list[bytes], n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), kind, np.int32)), pa.array(grams, pa.binary()), pa.array(n)], ["kind", "gram", "n"])

    def summed(held: list[pa.RecordBatch], hasher: WordHasher) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        spot, grams, n = whole.column("spot").to_numpy(), whole.column("gram").chunk(0), whole.column("n").to_numpy()
        offsets = np.frombuffer(grams.buffers()[1], np.int32)[grams.offset : grams.offset + len(grams) + 1].astype(np.int64)
        flat = np.frombuffer(grams.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets -= offsets[0]
        one, two = blanks_of(flat, offsets)
        run = np.cumsum(np.append(0, spot[1:] != spot[:-1])).astype(np.uint64) << np.uint64(40)
        finest = (spot & 3) == _EDGE
        for kind, ends in ((_EDGE, offsets[1:]), (_PAIR, two), (_WORD, one)):
            (key,) = hasher.between(flat, [offsets[:-1]], [ends])
            if kind != _WORD:
                key = run | (key >> np.uint64(24))
            order = np.argsort(key, kind="stable")
            head = np.flatnonzero(np.append(True, key[order[1:]] != key[order[:-1]]))
            total, at = np.add.reduceat(n[order], head), order[head]
            # the end is no word: such edges, and the pair of a piece's last word with it, are flow alone
            real = np.ones(len(at), bool)
            if kind != _WORD:
                real = (ends[at] > (two if kind == _EDGE else one)[at] + 1) & ((total >= least) | (kind == _PAIR) & finest[at])
            at, total = at[real], total[real]
            if len(at):
                yield rows(kind, [flat[a:b].tobytes() for a, b in zip(offsets[at].tolist(), ends[at].tolist(), strict=True)], total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = WordHasher(b" \n"), [], 0
        for b in batches:
            spot = b.column(0).to_numpy()
            last = int(np.searchsorted(spot, spot[-1]))  # the last spot's rows may go on in the next batch
            whole = last > 0 or size and held[-1].column(0)[-1].as_py() != spot[-1]
            if whole and size + last >= STEP_ROWS:
                yield from summed([*held, b.slice(0, last)], hasher)
                held, size, b = [], 0, b.slice(last)
            held.append(b)
            size += b.num_rows
        if size:
            yield from summed(held, hasher)

    return run


def score(a: str, left: str, right: str) -> str:
    """floor(SCALE * a * a / (left * right)); products of 38 digits."""
    d = lambda c: f"cast({c} as decimal(19,0))"
    return f"({SCALE}BD * ({d(a)} * {d(a)})) div ({d(left)} * {d(right)})"


def graph(docs: DataFrame, stage: StageTables, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (lang, w, n) and pairs (lang, w, n) that occur ``least`` times, w their words, and all words (lang, w, n)."""
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    hot = np.packbits(hot_slots(texts)).tobytes()
    dealt = texts.mapInArrow(_edges(hot, HELD_EDGES), "spot long, gram binary, n long").repartition(F.shiftright("spot", _PAIR_BITS + 2)).sortWithinPartitions("spot")
    found = stage.keep("flow", dealt.mapInArrow(_flow(least), "kind int, gram binary, n long"))

    def of(kind: int) -> DataFrame:
        own = found.filter(F.col("kind") == kind).select(F.col("gram").cast("string").alias("gram"), "n")
        if kind != _EDGE:  # an edge lies whole in one partition
            own = own.groupBy("gram").agg(F.sum("n").alias("n"))
        body = F.substring_index("gram", "\n", -1)
        return own.filter(F.col("n") >= (least if kind != _WORD else 1)).select(
            F.expr("substring(gram, 1, length(gram) - length(substring_index(gram, '\n', -1)) - 1)").alias("lang"), F.split(body, " ").alias("w"), "n",
        )

    return of(_EDGE), of(_PAIR), of(_WORD)


def paths(edges: DataFrame, pairs: DataFrame, stage: StageTables) -> DataFrame:
    """The compacted graph, rows (lang, w, n, first_n, last_n): a path's words, its weight and the counts of its outer pairs.

    Every round doubles how far an edge sees along its path. No path is a circle, as each occurrence enters it somewhere.
    """
    head, tail = F.slice("w", 1, 2), F.slice("w", 2, 2)
    counted = edges.withColumn("head", head).withColumn("tail", tail)
    for side in ("head", "tail"):
        counted = counted.join(pairs.select("lang", F.col("w").alias(side), F.col("n").alias(f"{side}_n")), ["lang", side])
    counted = stage.keep("edges", counted)
    into = counted.filter("n = tail_n").select("lang", F.col("tail").alias("node"), F.col("w").alias("e"))
    out = counted.filter("n = head_n").select("lang", F.col("head").alias("node"), F.col("w").alias("to"))
    seen = stage.keep("seen_0", into.join(out, ["lang", "node"]).select("lang", "e", "to", F.lit(1).cast("long").alias("steps")))
    for turn in itertools.count(1):
        ahead = seen.select("lang", F.col("e").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"))
        step = stage.keep(f"seen_{turn}", seen.join(ahead, ["lang", "to"], "left").select(
            "lang", "e", F.coalesce("far", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("far").isNotNull().alias("moved"),
        ))
        seen = step.drop("moved")
        if not step.filter("moved").limit(1).count():
            break
    members = counted.join(seen.withColumnRenamed("e", "w"), ["lang", "w"], "left").select(
        "lang", F.coalesce("to", "w").alias("path"), F.struct((-F.coalesce("steps", F.lit(0))).alias("at"), "w", "n", "head_n", "tail_n").alias("edge"),
    )
    # the edges of a path are no more than the words of one piece
    return members.groupBy("lang", "path").agg(F.array_sort(F.collect_list("edge")).alias("edges")).select(
        "lang",
        F.concat(F.col("edges")[0]["w"], F.transform(F.slice("edges", 2, F.size("edges")), lambda e: e["w"][2])).alias("w"),
        F.col("edges")[0]["n"].alias("n"), F.col("edges")[0]["head_n"].alias("first_n"), F.element_at("edges", -1)["tail_n"].alias("last_n"),
    )


def phrases(docs: DataFrame, stage: StageTables, least: int = LEAST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases of 2 and 3 words: lang, rank, phrase, a, l, r, n, score.

    A null language is ``und``, together with texts that say so; a null text is empty. Repeated rows count again. Equal scores go by a and then
    by the phrase's bytes. Only lang and text are read, so other columns cannot clash. An empty table gives an empty result.
    """
    edges, pairs, words = graph(docs, stage, least)
    pairs, words = stage.keep("pairs", pairs), stage.keep("words", words)
    compact = stage.keep("paths", paths(edges, pairs, stage))
    inner = F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.slice("w", i, 2))).alias("at", "pair")
    covered = compact.select("lang", "n", inner).groupBy("lang", F.col("pair").alias("w")).agg(F.max("n").alias("cover"))
    two = pairs.join(covered, ["lang", "w"], "left").filter(f"cover IS NULL OR 100 * cover < {cover} * n").select(
        "lang", "w", F.col("n").alias("a"), F.lit(None).cast("long").alias("front"), F.lit(None).cast("long").alias("back"),
    )
    three = compact.select("*", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.slice("w", i, 3))).alias("at", "triple")).select(
        "lang", F.col("triple").alias("w"), F.col("n").alias("a"), F.when(F.col("at") == 0, F.col("first_n")).otherwise(F.col("n")).alias("front"),
        F.when(F.col("at") == F.size("w") - 3, F.col("last_n")).otherwise(F.col("n")).alias("back"),
    )
    known = words.filter(F.col("n") >= least).select("lang", F.col("w")[0].alias("word"), F.col("n").alias("f"))
    both = two.unionByName(three).withColumn("first", F.col("w")[0]).withColumn("last", F.element_at("w", -1))
    for side in ("first", "last"):
        both = both.join(known.select("lang", F.col("word").alias(side), F.col("f").alias(f"{side}_f")), ["lang", side])
    cuts = both.withColumn("one", F.expr(score("a", "first_f", "coalesce(back, last_f)"))).withColumn("two", F.expr(f"if(front IS NULL, null, {score('a', 'front', 'last_f')})"))
    later = F.col("two") < F.col("one")
    scored = cuts.select(
        "lang", F.array_join("w", " ").alias("phrase"), "a", F.when(later, F.col("front")).otherwise(F.col("first_f")).alias("l"),
        F.when(later, F.col("last_f")).otherwise(F.coalesce("back", "last_f")).alias("r"), F.least("one", "two").alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
