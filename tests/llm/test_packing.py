import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lumenmart.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "The quick  Brown fox", None, "", "tab\tand\nnew\r\nlines", " a", "  a", "a ", "a \n b", "a\n \nb", "it's we'll <|endoftext|> x", "ábc é ́x", "日本語 テキスト。 x", "word,. foo.bar a.,! b",
    "x" * 3000, "   a", " ", "　 a 　b", " 's 's a's", "12 345 ½ ² a½.", "foo\x1c bar \x1cx", "word " * 5000, "word " * 5000, "one two three " * 180,
]


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def whole(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


def hold(rows, texts, window):
    """Every id in exactly one piece, checksums of the right ids, sequences without gaps and within the window; the share of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert sorted(by_doc) == sorted(texts)
    for doc_id, text in texts.items():
        ids, at = np.array(whole(text), "<u4"), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes())) and r.length > 0
            at += r.length
        assert at == len(ids)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return 1 - sum(r.length for r in rows) / (len(by_sequence) * window)


@pytest.mark.parametrize("window", [16, 256, 1024])
def test_ids_lie_in_one_piece_each(spark, window):
    docs = spark.createDataFrame([(7 * i % 23, t, 0, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, start int, length int").repartition(5)
    hold(packing.pack(docs, PATH, window=window).collect(), {7 * i % 23: t for i, t in enumerate(TEXTS)}, window)


def test_little_padding_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert hold(packing.pack(docs, PATH).collect(), {r.doc_id: r.text for r in docs.collect()}, 1024) < 0.003


def test_nulls_repeats_empty(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (2, None)], "doc_id long, text string")
    rows = packing.pack(docs, PATH).collect()
    assert sorted((r.doc_id or -1, r.length, r.doc_tokens) for r in rows) == [(-1, 2, 2), (1, 2, 2), (1, 2, 2), (2, 1, 1)]
    assert sorted(r.offset for r in rows)[0] == 0 and len({r.sequence_id for r in rows}) == 1
    assert packing.pack(docs.limit(0), PATH).count() == 0
    assert {r.ids_crc32 for r in packing.pack(docs.select(F.col("doc_id").cast("string").alias("k"), "text"), PATH, id_col="k").collect()} == {r.ids_crc32 for r in rows}


@pytest.mark.parametrize("lengths", [[1] * 10, [511, 513] * 50, [1000] * 99, list(range(1, 1025)) * 7, [340, 342] * 30 + [1024] * 5, []])
def test_the_plan_places_every_piece_once(lengths):
    counts = np.bincount(np.array(lengths, int), minlength=1025)
    runs, kept_whole, sequences = packing.plan(counts, 1024)
    used = np.zeros(1025, int)
    np.add.at(used, runs[:, 0], runs[:, 4])
    cut = counts - kept_whole
    expected = kept_whole.copy()
    expected[512] += cut.sum()
    expected[1:512] += cut[513:1024]
    assert (used == expected).all() and -(-sum(lengths) // 1024) <= sequences <= 2 + sum(lengths) // 1000


def test_least_squares_finds_what_fills_exactly():
    combos = packing.combinations(np.array([100, 300, 424, 600, 900, 124]), 1024)
    assert sorted(map(tuple, combos.tolist())) == [(0, 124, 900), (0, 424, 600), (124, 300, 600), (300, 300, 424)]
    counts = np.zeros(1025)
    counts[[300, 424, 600]] = 200, 150, 50  # 100 times (300, 300, 424) and 50 times (424, 600)
    x = {tuple(c): round(v) for c, v in zip(packing.combinations(np.array([300, 424, 600]), 1024).tolist(), packing.solve(packing.combinations(np.array([300, 424, 600]), 1024), counts), strict=True)}
    assert x == {(0, 424, 600): 50, (300, 300, 424): 100}
