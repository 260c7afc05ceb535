"""Jaccard join of shingle sets by signature trees.

Finding who may meet: two sets that link differ in at most k shingles, k given by their sizes. Shingles are dealt by
hash into k + 1 + m slots, so at least m + 1 slots hold the same shingles in both sets. Each set drops its m lightest
slots and hands out a hash of each of the others; as the order of slots depends only on what they hold, a linking pair
has a hash in common. With t more slots it has t + 1 of them in common: a set that shares fewer hashes with all others together
links with none, and of those it shares each set may leave out the t that most sets hold. Components of the hashes left are
candidate classes, and no linking pair lies across two of them. Equal sets are one node here, named by a number of their content.
The lightest slots are those with the fewest shingles that are not common: a fixed number of counters, summed over all texts,
tells which are, so passages that many texts share do not draw their classes together.

Deciding who does: in each class the sets form a signature tree. A node holds the OR of its sets' token bitmaps and the
range of their sizes; two trees (or one with itself) are walked together from their roots, and a pair of nodes
whose greatest possible overlap is too small for its smallest sets goes with all below it. Pairs of sets that
reach the leaves are compared exactly unless they are connected already. A class too large for one tree is
cut into trees that are compared pair by pair where their components differ.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm.common import TEXT_BYTES, components, give_back, map_arrow, slices, small_side
from orderloom.llm.shingles import Hasher, mix
from orderloom.sources.stage import StageTables

TREE_SETS, TREE_SHINGLES = 2500, 1_500_000  # sets and shingles in one tree, at most (one larger set is a tree alone)
FAN = 8
BATCH_ROWS, PORTION_SHINGLES = 2_500, 500_000  # texts and shingles of them that a task holds at a time
COUNTERS = 1 << 20
_COUNTER_SHIFT, _SEGMENTS = np.uint64(44), 16
_NODE_BITS, _MOST_SHARED = 48, 255
_NODE = np.int64((1 << _NODE_BITS) - 1)  # sets or signatures that fall on one number only make candidate classes larger


@dataclass(frozen=True)
class Rule:
    """Link when 100 * intersection >= percent * union.

    ``spare`` is the share of extra slots, so that the lightest can be dropped, ``shared`` that of slots a pair must have in common beyond the first,
    and ``ratio`` that of the bounds of size classes, 100 / percent at least. They change which sets meet and never what links. Where slots
    hold few shingles, so that unlike sets drop too few empty ones and meet by them, more spare slots and narrower classes keep candidate
    classes small; where long texts share passages, so do more shared slots.
    """

    words: int
    percent: int
    spare: float = 0.15
    ratio: float = 1.5
    shared: float = 0.0

    def links(self, overlap, a, b):
        return (100 + self.percent) * overlap >= self.percent * (a + b)

    def bounds(self, largest: int) -> np.ndarray:
        """Upper set sizes of the size classes; a linking pair lies in one class or in two neighbours."""
        upper = max(1, -(-(100 + self.percent) // (2 * (100 - self.percent))) - 1) if self.percent < 100 else largest
        out = [upper]
        while out[-1] < largest:
            out.append(max(out[-1] + 1, int(out[-1] * self.ratio)))
        return np.array(out, np.int64)

    def slots(self, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots of a class, how many of them a set drops, and how many of the others a linking pair has in common at least."""
        differing = 2 * upper * (100 - self.percent) // (100 + self.percent)
        spare, more = ((share * (differing + 1)).astype(np.int64) for share in (self.spare, self.shared))
        return differing + 1 + spare + more, spare, 1 + more


_MEASURED = "share long, segment long, counts binary, doc_id long, b long, n long, more long"


def _measure(rule: Rule):
    """A row (doc_id, b, n, more) per text, two numbers of its set and its size, and rows of counters of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = Hasher(rule.words), np.zeros(COUNTERS, np.int64)
        for b in (p for whole in batches for p in slices(whole, 1, TEXT_BYTES, BATCH_ROWS)):
            sets = list(hasher.sets(b.column(1).to_pylist()))
            counts += _counted(sets)
            n, first, second = _marks(sets)
            yield _measured([b.column(0), *(pa.array(x.view(np.int64)) for x in (first, n, second))], 3, 7)
        task = TaskContext.get().partitionId() % 64
        give_back()
        parts = [zlib.compress(p.tobytes(), 1) for p in counts.reshape(_SEGMENTS, -1)]
        yield _measured([pa.array(np.full(_SEGMENTS, task)), pa.array(np.arange(_SEGMENTS)), pa.array(parts, pa.binary())], 0, 3)

    return run


def _measured(columns: list, first: int, last: int) -> pa.RecordBatch:
    none = [pa.nulls(len(columns[0]), pa.binary() if i == 2 else pa.int64()) for i in range(7)]
    return pa.RecordBatch.from_arrays([*none[:first], *columns, *none[last:]], ["share", "segment", "counts", "doc_id", "b", "n", "more"])


def _marks(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([len(s) for s in sets], np.int64)
    return n, *(np.array([mix(s + np.uint64(c)).sum(dtype=np.uint64) for s in sets], np.uint64) for c in (1, 2))


def common_shingles(measured: DataFrame) -> np.ndarray:
    """Which of ``COUNTERS`` counters hold common shingles: those well above the mean over all texts.

    Counters are summed in two steps, so that no group holds more than a share of the tasks' counts.
    """

    def add(table):
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in table.column("counts").to_pylist())
        first = [table.column(c)[:1] for c in ("share", "segment")]
        return pa.table([*first, pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["share", "segment", "counts"])

    types = "share long, segment long, counts binary"
    parts = measured.filter("segment IS NOT NULL").select("share", "segment", "counts")
    summed = parts.groupBy("share", "segment").applyInArrow(add, types)
    rows = summed.groupBy("segment").applyInArrow(add, types).orderBy("segment").collect()  # one row per segment
    if not rows:
        return np.zeros(COUNTERS, bool)
    counts = np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), np.int64) for r in rows])
    return counts > max(2 * counts.mean(), 20)


def _counted(sets: list[np.ndarray]) -> np.ndarray:
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return np.bincount((flat >> _COUNTER_SHIFT).astype(np.int64), minlength=COUNTERS)


def signatures(sets: list[np.ndarray], rule: Rule, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(place of the set, signature) of all sets of at least one shingle. ``common`` tells the counters of common shingles."""
    return signed(sets, rule, common)[:2]


def signed(sets: list[np.ndarray], rule: Rule, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``signatures``, with a number for each of the set's two classes: which it is, and how many signatures in it a linking pair shares at least."""
    size = np.array([len(s) for s in sets], np.int64)
    if not size.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    upper = rule.bounds(int(size.max() * 2 + 2))
    own = np.searchsorted(upper, size)
    flat = np.concatenate(sets)
    weighed = mix(flat + np.uint64(0x5851F42D4C957F2D))
    rare = np.ones(len(flat), bool) if common is None else ~common[(flat >> _COUNTER_SHIFT).astype(np.int64)]
    begin = np.cumsum(size) - size
    out = []
    for step in (0, 1):
        # the next class holds larger sets that may still link
        taking = np.flatnonzero((size > 0) & ((step == 0) | (100 * size >= rule.percent * (upper[own] + 1))))
        if not len(taking):
            continue
        kind = own[taking] + step
        slots, spare, shared = rule.slots(upper[kind])
        base = np.cumsum(slots) - slots
        n = size[taking]
        at = np.arange(n.sum()) + np.repeat(begin[taking] - (np.cumsum(n) - n), n)
        slot = (((flat[at] >> np.uint64(32)) * np.repeat(slots, n).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        place = np.repeat(base, n) + slot  # rises along each set, as its shingles are sorted
        total = int(slots.sum())
        count = np.bincount(place, minlength=total)
        held = np.zeros(total, np.uint64)
        heads = np.flatnonzero(np.diff(place, prepend=-1))
        held[place[heads]] = np.add.reduceat(weighed[at], heads)
        owner = np.repeat(np.arange(len(taking)), slots)
        number = (np.arange(total) - base[owner]).astype(np.uint64)
        signature = mix(held ^ mix(number + (kind[owner].astype(np.uint64) << np.uint64(32)) + (count.astype(np.uint64) << np.uint64(44))))
        # the same shingles give the same weight, so equal slots stand alike in both orders
        weight = np.bincount(place[rare[at]], minlength=total)
        order = np.lexsort((signature, count, weight, owner))
        kept = order[(np.arange(total) - base[owner[order]]) >= spare[owner[order]]]
        need = np.minimum(shared, _MOST_SHARED) + step * (_MOST_SHARED + 1)
        out.append((taking[owner[kept]], signature[kept], need[owner[kept]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Tree:
    """Signature tree over sorted sets; level 0 are the sets, each level above joins ``FAN`` nodes."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.sets = sets
        words = bits // 64
        maps = np.zeros((len(sets), words), np.uint64)
        for i, s in enumerate(sets):
            spot = s & np.uint64(bits - 1)
            np.bitwise_or.at(maps[i], (spot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spot & np.uint64(63)))
        size = np.array([len(s) for s in sets], np.int64)
        lost = size - np.bitwise_count(maps).sum(1).astype(np.int64)  # shingles that share a bit
        self.levels = [(maps, size, size, lost)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, lost = self.levels[-1]
            cut = np.arange(0, len(maps), FAN)
            self.levels.append((
                np.bitwise_or.reduceat(maps, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(lost, cut),
            ))


def may_link(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, rule: Rule) -> np.ndarray:
    """Whether nodes i of one level and j of another can hold a linking pair."""
    (maps, low, high, lost), (maps2, low2, high2, lost2) = a, b
    fits = (100 * high[i] >= rule.percent * low2[j]) & (100 * high2[j] >= rule.percent * low[i])
    step = max(1, (1 << 21) // maps.shape[1])
    for at in range(0, len(i), step):
        part = np.flatnonzero(fits[at : at + step]) + at
        p, q = i[part], j[part]
        # equal shingles set equal bits; shingles hidden behind another's bit are added back
        most = np.bitwise_count(maps[p] & maps2[q]).sum(1).astype(np.int64) + np.minimum(lost[p], lost2[q])
        most = np.minimum(most, np.minimum(high[p], high2[q]))
        fits[part] = rule.links(most, low[p], low2[q])
    return fits


def leaf_pairs(a: Tree, b: Tree | None, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that the walk down both trees cannot rule out; within one tree each pair once."""
    other = b or a
    i = j = np.zeros(1, np.int64)
    down, down2 = len(a.levels) - 1, len(other.levels) - 1
    while True:
        if b is None:
            keep = i < j if down == 0 else i <= j
            i, j = i[keep], j[keep]
        keep = may_link(a.levels[down], i, other.levels[down2], j, rule)
        i, j = i[keep], j[keep]
        if down == 0 and down2 == 0 or not len(i):
            return i, j
        # the higher one goes down, both where they are level
        first, second = down >= down2, down2 >= down
        if first:
            i, j = _children(i, j, len(a.levels[down - 1][0]))
        if second:
            j, i = _children(j, i, len(other.levels[down2 - 1][0]))
        down, down2 = down - first, down2 - second


def _children(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    child = (i[:, None] * FAN + np.arange(FAN)).ravel()
    keep = child < n
    return child[keep], np.repeat(j, FAN)[keep]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def forest(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray | None, group: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Links that connect what links among sets ``first`` (or between ``first`` and ``second``) and not yet in one ``group``."""
    bits = 1 << min(17, max(9, int(8 * max(len(s) for s in sets) - 1).bit_length()))
    least = np.array([s[0] for s in sets], np.uint64)  # alike sets mostly share their smallest shingle, so they become neighbours
    orders = [np.array(sorted(part.tolist(), key=lambda x: (least[x], len(sets[x])))) for part in (first, second) if part is not None]
    trees = [Tree([sets[x] for x in order], bits) for order in orders]
    i, j = leaf_pairs(trees[0], trees[1] if len(trees) > 1 else None, rule)
    i, j = orders[0][i], orders[-1][j]
    group, links = group.copy(), []
    for at in range(0, len(i), 4096):
        p, q = i[at : at + 4096], j[at : at + 4096]
        for x, y in zip(p[open_ := group[p] != group[q]].tolist(), q[open_].tolist(), strict=True):
            if group[x] != group[y] and rule.links(overlap(sets[x], sets[y]), len(sets[x]), len(sets[y])):
                links.append((x, y))
                group[group == group[y]] = group[x]
    return links


def _propose(rule: Rule, bits: bytes):
    """Rows (key, a) of a batch of texts: a signature, and the set's node below what ``signed`` says of the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, common = Hasher(rule.words), np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        for b in (p for whole in batches for p in slices(whole, 1, TEXT_BYTES, BATCH_ROWS)):
            sets = list(hasher.sets(b.column(1).to_pylist()))
            n, *marks = _marks(sets)
            known = ~np.array(b.column(0).is_null())
            # of equal sets in the batch one with an id speaks for all
            able = np.flatnonzero(known & (n > 0))
            _, speaker = np.unique(np.stack([*marks, n.astype(np.uint64)], 1)[able], axis=0, return_index=True)
            # some sets at a time, so that their slots fit in memory
            taken = np.sort(able[speaker])
            for part in np.split(taken, np.flatnonzero(np.diff(np.cumsum(n[taken]) // PORTION_SHINGLES)) + 1):
                place, signature, need = signed([sets[i] for i in part], rule, common)
                yield _rows(signature.view(np.int64) & _NODE, (marks[0][part][place].view(np.int64) & _NODE) + (need << _NODE_BITS), names=["key", "a"])
            give_back()

    return run


def _rows(*columns: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted rows as an array per column, each once, with those of equal first column together, and where such runs begin."""
    held = None
    for b in batches:
        part = np.stack([c.to_numpy() for c in b.columns])
        part = part if held is None else np.concatenate([held, part], 1)
        part = part[:, np.append(True, (part[:, 1:] != part[:, :-1]).any(0))[: part.shape[1]]]
        whole = int(np.searchsorted(part[0], part[0, -1])) if part.shape[1] else 0
        if whole:
            yield part[:, :whole], _starts(part[0, :whole])
        held = part[:, whole:]
    if held is not None and held.shape[1]:
        yield held, _starts(held[0])


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, x[1:] != x[:-1]))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, place, head) of signatures that several sets hold, of rows sorted by key and a: the place grows with the number of sets, head is one of them."""
    for (key, a), start in _runs(batches):
        size = np.diff(np.append(start, len(key)))
        of = np.repeat(np.arange(len(start)), size)
        held = size[of] > 1
        # no two signatures have one place, so that any two sets order those they share alike
        place = (np.minimum(size, (1 << 14)) << _NODE_BITS)[of] + key
        yield _rows(a[held], place[held], (a[start] & _NODE)[of][held], names=["a", "place", "head"])


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sets that may be in one class, of rows sorted by a and place: a set that shares enough signatures, without the most frequent of them, and their heads."""
    for (a, _, head), start in _runs(batches):
        size = np.diff(np.append(start, len(a)))
        need = (a[start] >> _NODE_BITS) & _MOST_SHARED
        of = np.repeat(np.arange(len(start)), size)
        kept = (np.arange(len(a)) - start[of] <= (size - need)[of]) & (a & _NODE != head)
        pairs = np.unique(np.stack([a[kept] & _NODE, head[kept]], 1), axis=0)
        yield _rows(pairs[:, 0], pairs[:, 1], names=["a", "b"])


def _sets_of(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """(class, node, tree, trees, s) of the wanted nodes, s being the bytes of the sorted shingles."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        data = [s.tobytes() for s in Hasher(rule.words).sets(b.column(3).to_pylist())]
        return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(data, pa.binary())], ["class", "node", "trees", "s"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("_text"))
    joined = texts.join(small_side(wanted), "node").select("class", "node", "trees", "_text")
    return map_arrow(joined, "class long, node long, trees long, s binary", batch, text=3)


def _links_of_groups(rule: Rule):
    """Links within each class of a group of rows (class, node, tile, label, s); with two tiles, between them."""

    def run(key, table):
        classes, nodes, tiles, labels = (table.column(c).to_numpy() for c in ("class", "node", "tile", "label"))
        raw = table.column("s").combine_chunks()
        a, b = [], []
        order = np.lexsort((nodes, classes))
        for rows in np.split(order, np.flatnonzero(np.diff(classes[order])) + 1):
            sets = [np.frombuffer(raw[int(r)].as_py(), np.uint64) for r in rows]
            full = np.array([len(s) > 0 for s in sets])
            rows, sets = rows[full], [s for s in sets if len(s)]
            if len(rows) < 2:
                continue
            _, group = np.unique(labels[rows], return_inverse=True)
            ends = np.unique(tiles[rows])
            parts = [np.flatnonzero(tiles[rows] == t) for t in ends]
            for x, y in forest(sets, parts[0], parts[1] if len(parts) > 1 else None, group, rule):
                a.append(int(nodes[rows[x]]))
                b.append(int(nodes[rows[y]]))
        give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def join(docs: DataFrame, stage: StageTables, rule: Rule) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    A null or empty text, and one without words, has no shingles and links with nothing. Equal sets always link. Rows
    that repeat an id are one node with a row each. A row with a null id links with nothing and has a null component.
    Other columns are not read. An empty table gives an empty result.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measured = stage.keep("measured", narrow.mapInArrow(_measure(rule), _MEASURED))
    bits = np.packbits(common_shingles(measured)).tobytes()
    sizes = measured.filter("segment IS NULL").select("doc_id", "b", "n", "more")
    alike = sizes.filter("doc_id IS NOT NULL AND n > 0")
    speakers = stage.keep("speakers", alike.groupBy("b", "more", "n").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows")))
    copies = alike.join(speakers.filter("rows > 1"), ["b", "more", "n"]).filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    proposed = narrow.mapInArrow(_propose(rule, bits), "key long, a long")
    meeting = proposed.repartition("key").sortWithinPartitions("key", "a").mapInArrow(_meet, "a long, place long, head long")
    pairs = meeting.repartition("a").sortWithinPartitions("a", "place").mapInArrow(_connect, "a long, b long")
    classes = components(pairs, stage, "classes").select(F.col("node").alias("mark"), F.col("component_id").alias("class"))
    # one speaker of each kind of set, in classes that hold several
    named = speakers.select(F.col("b").bitwiseAND(F.lit(int(_NODE))).alias("mark"), "node", "n")
    members = stage.keep("members", classes.join(named, "mark").select("class", "node", "n"))
    held = members.groupBy("class").agg(F.count("*").alias("c"), F.sum("n").alias("t")).filter("c > 1").select(
        "class", F.greatest(F.ceil(F.col("c") / TREE_SETS), F.ceil(F.col("t") / TREE_SHINGLES)).alias("trees"), "t",
    )
    held = stage.keep("held", held)
    wanted = stage.keep("wanted", members.join(held.select("class", "trees"), "class").select("class", "node", "trees").distinct())
    sets = stage.keep("sets", _sets_of(narrow, wanted, rule))
    small = held.filter("trees = 1").agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]
    bins = max(1, -(-small // TREE_SHINGLES))
    alone = F.lit(0).alias("tile"), F.col("node").alias("label")
    one = sets.filter("trees = 1").select(F.lit(-1).cast("long").alias("g"), F.pmod(F.xxhash64("class"), F.lit(bins)).alias("h"), "class", "node", *alone, "s")
    # a class of many trees is cut twice in different ways, so that the components of its trees grow together
    many = sets.filter("trees > 1").withColumn("cut", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.col("class").alias("g"), (F.pmod(F.xxhash64("node", "cut"), F.col("trees")) * 2 + F.col("cut") - 1).alias("h"), "class", "node", *alone, "s",
    )
    run = _links_of_groups(rule)
    links = stage.keep("links", one.union(many).groupBy("g", "h").applyInArrow(run, "a long, b long"))
    if held.filter("trees > 1").limit(1).count():
        links = links.union(_across(sets.filter("trees > 1"), links, stage, rule))
    labels = components(links.union(copies), stage, "components")
    named = sizes.join(labels, sizes["doc_id"] == labels["node"], "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _across(sets: DataFrame, links: DataFrame, stage: StageTables, rule: Rule) -> DataFrame:
    """Links between trees of large classes whose sets are still in different components.

    Components larger than a tree get tiles of their own, all others share tiles; every two tiles of a class meet but
    those of one large component.
    """
    labels = components(links, stage, "inner")
    named = sets.select("class", "node", F.octet_length("s").alias("bytes")).join(labels, "node", "left").withColumn("label", F.coalesce("component_id", "node"))
    parts = named.groupBy("class", "label").agg(F.count("*").alias("c"), (F.sum("bytes") / 8).alias("t"))
    parts = parts.withColumn("cut", F.greatest(F.ceil(F.col("c") / TREE_SETS), F.ceil(F.col("t") / TREE_SHINGLES)))
    parts = stage.keep("inner-parts", parts)
    open_classes = parts.groupBy("class").agg(
        F.count("*").alias("labels"), F.sum(F.when(F.col("cut") == 1, F.col("c"))).alias("c"), F.sum(F.when(F.col("cut") == 1, F.col("t"))).alias("t"),
    ).filter("labels > 1").select(
        "class", F.coalesce(F.greatest(F.ceil(F.col("c") / TREE_SETS), F.ceil(F.col("t") / TREE_SHINGLES)), F.lit(0)).alias("shared"),
    )
    # numbers of a class's tiles: first the shared ones, then each large component's in a row
    before = Window.partitionBy("class").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    large = parts.filter("cut > 1").join(open_classes, "class").withColumn("first", F.col("shared") + F.coalesce(F.sum("cut").over(before), F.lit(0)))
    large = stage.keep("inner-large", large.select("class", "label", "cut", "first"))
    total = stage.keep("inner-total", open_classes.join(large.groupBy("class").agg(F.sum("cut").alias("more")), "class", "left").select(
        "class", "shared", (F.col("shared") + F.coalesce("more", F.lit(0))).alias("tiles"),
    ))
    placed = named.select("class", "node", "label").join(total, "class").join(large, ["class", "label"], "left").select(
        "class", "node", "label", "tiles", "first", "cut",
        F.when(F.col("cut").isNotNull(), F.col("first") + F.pmod(F.xxhash64("node"), F.col("cut")))
        .otherwise(F.pmod(F.xxhash64("label"), F.col("shared"))).cast("int").alias("tile"),
    )
    placed = stage.keep("inner-placed", placed)
    met = F.filter(F.sequence(F.lit(0), (F.col("tiles") - 1).cast("int")), lambda t: F.when(F.col("cut").isNull(), F.lit(True)).otherwise(
        (t < F.col("first")) | (t >= F.col("first") + F.col("cut"))
    ))
    dealt = sets.select("class", "node", "s").join(placed, ["class", "node"]).withColumn("other", F.explode(met)).select(
        F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "class", "node", "tile", "label", "s",
    )
    return stage.keep("inner-links", dealt.groupBy("class", "p", "q").applyInArrow(_links_of_groups(rule), "a long, b long"))
