"""Documents cut into token pieces and packed into sequences of 1024 by shortest-pack-first over the length histogram.

The histogram has at most 1024 rows whatever the corpus holds. Lengths are placed longest first into
groups of equal packs, so only counts of packing patterns are kept; the pieces then take their places
by their rank among the pieces of the same length.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import give_back, kept_in_process, slices
from orderloom.operators.prefix import lay_out
from orderloom.sources.stage import StageTables

SEQUENCE = 1024
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"  # a file of the public_tokenizers package, or a path
CACHED_UNITS = 500_000  # units whose ids a worker process keeps, about 250 bytes each
PORTION_BYTES = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class ChunkEncoder:
    """Token ids of texts, with the ids of each unit kept: a word with the blank or the line feed before it.

    The vocabulary cuts a text before every single blank and around every single line feed between two other characters and encodes
    what lies between on its own, so a unit always has the same ids. A text with any other white space next to a blank or a line feed, or with a token that the file
    adds to its vocabulary, is encoded in one go.
    """

    def __init__(self, vocabulary: str, most_units: int = CACHED_UNITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary if os.path.sep in vocabulary else public_tokenizers.path(vocabulary))
        blank = np.array([self.tokenizer.id_to_token(i).startswith("\u0120") for i in range(self.tokenizer.get_vocab_size())])
        self.leads = blank  # ids that begin with a blank, and the line feed's
        self.leads[[i for i in (self.tokenizer.token_to_id("\u010a"),) if i is not None]] = True
        self.most_units = most_units
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts, self.lengths, self.used, self.odd = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _forget(self) -> None:
        """Keep the words used most, half of what may be kept; all uses count half from now on."""
        kept = np.sort(np.argsort(-self.used, kind="stable")[: self.most_units // 2])
        words = list(self.known)
        self.known = {words[i]: at for at, i in enumerate(kept.tolist())}
        lengths = self.lengths[kept]
        ends = np.cumsum(lengths)
        self.ids = self.ids[np.arange(lengths.sum()) + np.repeat(self.starts[kept] - (ends - lengths), lengths)]
        self.starts, self.lengths, self.used, self.odd = ends - lengths, lengths, self.used[kept] // 2, self.odd[kept]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[str]) -> None:
        """Encode new units in one text; each one's ids begin at an id with a leading blank or at the line feed's. Odd units have none."""
        odd = np.array([not u or u[-1].isspace() or u[0].isspace() and (u[0] != "\n" or u[1:2].isspace()) for u in units], bool)
        (found,) = self._ids(["".join(u if u[0] == "\n" else " " + u for u, o in zip(units, odd.tolist(), strict=True) if not o)])
        begins = np.append(np.flatnonzero(self.leads[found]), len(found))
        starts, lengths = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        starts[~odd], lengths[~odd] = begins[:-1] + len(self.ids), np.diff(begins)
        self.known.update(zip(units, range(len(self.starts), len(self.starts) + len(units)), strict=True))
        self.ids = np.concatenate([self.ids, found])
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        self.odd, self.used = np.concatenate([self.odd, odd]), np.concatenate([self.used, np.zeros(len(units), np.int64)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if not any(a in t for a in self.added)]
        split = [texts[i].replace("\n", " \n").split(" ") for i in plain]
        rest = [c for chunks in split for c in chunks[1:]]
        places = np.fromiter(map(self.known.get, rest, itertools.repeat(-1)), np.int64, len(rest))
        unknown = np.flatnonzero(places < 0).tolist()
        if unknown:
            self._learn(list(dict.fromkeys(rest[i] for i in unknown)))
            places[unknown] = [self.known[rest[i]] for i in unknown]
        self.used += np.bincount(places, minlength=len(self.used))
        lengths, odd = self.lengths[places], self.odd[places]
        ends = np.cumsum(lengths)
        # a portion has far fewer ids than 2^31
        flat = self.ids[np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32) + np.repeat((self.starts[places] - (ends - lengths)).astype(np.int32), lengths)]
        upto = np.append(0, ends)
        at = 0
        for i, chunks, first in zip(plain, split, self._ids([c[0] for c in split]), strict=True):
            to = at + len(chunks) - 1
            if to == at or not (not chunks[0] or chunks[0][-1].isspace() or odd[at:to].any()):
                out[i] = np.concatenate([first, flat[upto[at] : upto[to]]])
            at = to
        whole = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
            out[i] = ids
        if len(self.known) > self.most_units:
            self._forget()
        return out


def coder_of(vocabulary: str, most_units: int) -> ChunkEncoder:
    """The process's one encoder of this vocabulary; it outlives tasks, and what it remembers is bounded."""
    coders = kept_in_process("coders")
    if vocabulary not in coders:
        coders[vocabulary] = ChunkEncoder(vocabulary, most_units)
    coders[vocabulary].most_units = most_units
    return coders[vocabulary]


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = SEQUENCE, most_units: int = CACHED_UNITS) -> DataFrame:
    """Pieces of at most ``size`` ids of every row of ``docs``: whole ``size`` ids while they last, then the rest.

    A null or empty text is its end id alone. Null and repeated ids keep their own pieces. Columns other
    than doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(vocabulary, most_units)
        for b in (p for whole in batches for p in slices(whole, 1, PORTION_BYTES)):
            out = [[], [], [], [], []]
            for doc_id, ids in zip(b.column(0).to_pylist(), coder.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    for column, value in zip(out, (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def shortest_pack_first(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order, number of sequences). Lengths go longest first, each to the shortest pack it fits.

    Packs of equal pattern are one entry with a count. ``open_packs[gap]`` holds the patterns that miss ``gap`` ids.
    """
    open_packs: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            gap = next((g for g in range(size, length - 1, -1) if open_packs.get(g)), None)
            if gap is None:
                pattern, count = (), left
            else:
                pattern, count = next(iter(open_packs[gap].items()))
                if count <= left:
                    del open_packs[gap][pattern]
                else:
                    open_packs[gap][pattern] = count - left
                    count = left
            room = (size if gap is None else gap) - length
            grown = (*pattern, length)
            open_packs[room][grown] = open_packs[room].get(grown, 0) + count
            left -= count
    return [(p, n) for gap in sorted(open_packs) for p, n in open_packs[gap].items()]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, offset): ranks from one row's first to the next take them in turn."""
    rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    given: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, count in patterns:
        for length, offset in zip(pattern, itertools.accumulate(pattern, initial=0), strict=False):
            rows[length].append((given[length], sequence, offset))
            given[length] += count
        sequence += count
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def pack(
    docs: DataFrame, stage: StageTables, vocabulary: str = VOCABULARY, size: int = SEQUENCE, most_units: int = CACHED_UNITS
) -> DataFrame:
    """Pieces of ``docs`` with their sequence and their offset in it.

    Pieces are ordered by length in ranges, which may cut a very common length into many; a rank within a
    length is then the piece's place in its range plus what earlier ranges hold of that length. An empty
    table gives no pieces. ``most_units`` trades a worker's memory for time and changes no id.
    """
    laid = lay_out(stage.keep("pieces", pieces(docs, vocabulary, size, most_units)), [F.col("length"), F.col("doc_id"), F.col("start")])
    # one row per range and length: ranges are ordered by length, so there are at most ranges + lengths rows
    held = laid.groupBy("_gp_part", "length").agg(F.count("*").alias("n"), F.min("_gp_pos").alias("at")).orderBy("_gp_part", "length").collect()
    histogram: dict[int, int] = defaultdict(int)
    first: dict[tuple[int, int], int] = {}
    for row in held:
        first[row["_gp_part"], row["length"]] = histogram[row["length"]] - row["at"]
        histogram[row["length"]] += row["n"]
    table = places(shortest_pack_first(dict(histogram), size))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, pos, length = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("_gp_part", "_gp_pos", "length"))
            sequence, offset = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
            for p, n in {*zip(part.tolist(), length.tolist(), strict=True)}:
                own = (part == p) & (length == n)
                rank, rows = pos[own] + first[p, n], table[n]
                at = np.searchsorted(rows[:, 0], rank, side="right") - 1
                sequence[own], offset[own] = rows[at, 1] + rank - rows[at, 0], rows[at, 2]
            kept = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return laid.mapInArrow(place, PIECES + ", sequence_id long, offset long")
