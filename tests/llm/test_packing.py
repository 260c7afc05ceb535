"""Pieces against the tokenizer itself, packing as an exact cover, odd rows."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from orderloom.llm import packing
from orderloom.llm.queries import QUERIES
from orderloom.sources.stage import StageTables
from tests.conftest import SMALL

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
CODER = packing.ChunkEncoder(packing.VOCABULARY)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=" ab'sé1.\n\t  <|endoftext|>", max_size=40))
def test_words_have_the_ids_of_the_whole_text(text):
    assert CODER.encode([text])[0].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 1024), st.integers(1, 400), max_size=60))
def test_every_piece_has_one_place(histogram):
    patterns = packing.shortest_pack_first(histogram)
    used = Counter()
    for pattern, n in patterns:
        assert sum(pattern) <= 1024 and n > 0
        for length in pattern:
            used[length] += n
    assert used == Counter(histogram)


def test_forgetting_changes_nothing():
    coder = packing.ChunkEncoder(packing.VOCABULARY, 3)
    for text in ("a b c d e f", "g h a b", "a b c d e f g  h", "x a y z a", "a b c"):
        assert len(coder.known) <= 3
        assert coder.encode([text])[0].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_a_token_that_the_file_adds():
    texts = ["foo <|endoftext|> bar", "a<|endoftext|>b", "<|endoftext|>", "foo <| endoftext|> bar", "plain foo bar"]
    assert [x.tolist() for x in CODER.encode(texts)] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in CODER.encode(texts)[0]


def check_cover(rows, texts):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for k, text in texts.items():
        ids = np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return len(by_sequence)


def test_query_covers_every_id_once(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op8_packing"](spark, SMALL).collect()
    n = check_cover(rows, texts)
    assert n * 1024 < 1.02 * sum(r.length for r in rows) + 1024


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: "word " * 3000, 4: "a  b\n c", 5: "x" * 5000}
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, length int")
    check_cover(packing.pack(df, StageTables(spark)).collect(), texts)
    assert packing.pack(df.limit(0), StageTables(spark)).count() == 0
    twice = packing.pack(spark.createDataFrame([(1, "same")] * 3 + [(None, "same")], "doc_id long, text string"), StageTables(spark)).collect()
    assert len({(r.sequence_id, r.offset) for r in twice}) == 4
