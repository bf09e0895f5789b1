import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lumenmart.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "The quick  Brown fox", None, "", "tab\tand\nnew\r\nlines", "it's we'll no-break <|endoftext|>x", "ábc é ́x", "x" * 5000, "12 345 ½ ²", "日本語 テキスト",
    "it's 'tis o'd we'll've 'S''s a_b __init__ x2y ²³ ½ ªº µm ×÷ ŉ ſ İı Ĳ ĸ ŦŧŽž æøå ÿŸ ''", "\x1c\x1d odd   separators　wide", "ÀÉ ß İstanbul", "word " * 3000,
]


def whole(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def test_round_trip_equals_whole_texts(spark, tmp_path):
    docs = spark.createDataFrame([(7 * i % 13, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, start int").repartition(5)
    manifest = token_files.write(docs, str(tmp_path / "t"), PATH, length=16, shards=3)
    rows = sorted(token_files.read(manifest).collect())
    by = {7 * i % 13: whole(t) for i, t in enumerate(TEXTS)}
    at = 0
    for r in rows:
        ids = np.array(by[r.doc_id], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert [r.doc_id for r in rows] == list(range(13))


def test_sequences_are_views_of_equal_length(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(50)], "doc_id long, text string")
    first = token_files.write(docs, str(tmp_path / "s"), PATH, length=8, shards=1).first()
    reader = token_files.ShardReader(first.path)
    flat = [x for i in range(50) for x in whole(f"word{i} and more")]
    got = [reader.sequence(k) for k in range(reader.first[-1])]
    assert all(len(i) == len(m) == 8 and not i.flags.owndata and i.dtype == np.uint16 for i, m in got)
    assert [int(x) for i, m in got for x in i[m.to_numpy(zero_copy_only=False)]] == flat and first.tokens == len(flat)


def test_nulls_repeats_empty(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string")
    rows = token_files.encode_and_read(docs, PATH, str(tmp_path / "n")).collect()
    assert sorted((r.doc_id or -1, r.start) for r in rows) == [(-1, 0), (1, 2), (1, 4)]
    assert token_files.encode_and_read(docs.limit(0), PATH, str(tmp_path / "e")).count() == 0


def test_a_file_appears_only_when_complete(tmp_path):
    out = token_files.ShardWriter(str(tmp_path), 0, 4)
    out.add([1], [np.arange(10, dtype="<u4")])
    assert not (tmp_path / "shard-000000.arrow").exists()
    with pytest.raises(FileNotFoundError):
        token_files.ShardReader(str(tmp_path / "shard-000000.arrow"))
    out.close()
    assert next(token_files.ShardReader(str(tmp_path / "shard-000000.arrow")).documents())[2].tolist() == list(range(10))


def test_more_words_than_are_remembered():
    """Words that come again after, and while, the remembered ones are dropped."""
    from tokenizers import Tokenizer

    own, library = token_files.Encoder(PATH, remembered=5), Tokenizer.from_file(PATH)
    for k in "abcdefghijkl":
        texts = [t or "" for t in TEXTS] + [f"again w{k}x it's-{k} again{k}zq", " ".join(f"{k}q{c}" for c in "abcdefgh")]
        flat, at = own.encode_all(pa.array(texts))
        assert [flat[i:j].tolist() for i, j in zip(at, at[1:], strict=False)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    flat, at = own.encode_all(pa.array([], pa.string()))
    assert (len(flat), at.tolist()) == (0, [0])
