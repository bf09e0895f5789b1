import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece

from lumenmart.llm import piece_lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = [
    "hello  world   x    y", "▁a ▁b", " lead", "trail ", "Hello, World!!! (foo_bar) -> {x: 1.5}; //////// ---- *******", "def f(x):\n    return x**2\n\n\n",
    "日本語 テキスト ﬁ ² Ａ 😀 x²．", "a" * 3000, "aaaaab" * 20, "internationalization antidisestablishmentarianism", None, "", " ", "tab\tand\r\nlines", "ÀÉß İ é",
]


def texts():
    r = random.Random(8)
    return TEXTS + ["".join(r.choice("abcdefghijklmnopqrstuvwxyz   .,-'éß1") for _ in range(300)) for _ in range(40)]


def want(text):
    ids = LIBRARY.encode(text or "")
    return ids, zlib.crc32(np.array(ids, "<i4").tobytes())


def test_equals_the_library(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame([*rows, rows[0], (None, "no id", "x")], "doc_id long, text string, unit string").repartition(3)
    for frequent in (10_000, 50):  # few frequent units: most come by the join
        got = piece_lattice.encode(docs, PATH, settings=piece_lattice.Settings(frequent=frequent, block=64, chunk=2_000)).collect()
        assert len(got) == len(rows) + 2
        of = dict((i, t) for i, t, _ in rows) | {None: "no id"}
        for r in got:
            ids, crc = want(of[r.doc_id])
            assert (r.ids, r.n_tokens, r.ids_crc32) == (ids, len(ids), crc), of[r.doc_id]


def test_round_trip_and_empty(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    decoded = {r.doc_id: r.text for r in piece_lattice.decode_ids(piece_lattice.encode(docs, PATH), PATH).collect()}
    checked = {r.doc_id: r.text_crc32 for r in piece_lattice.encode_and_check(docs, PATH).collect()}
    for i, t in rows:
        text = (t or "").replace("▁", " ")
        assert decoded[i] == text and checked[i] == zlib.crc32(text.encode())
    assert piece_lattice.encode(docs.limit(0), PATH).count() == 0


def test_a_very_long_unit(spark):
    r = random.Random(3)
    text = "".join(r.choice("etaoinshrdlucmfwypé") for _ in range(100_000))
    docs = spark.createDataFrame([(1, text), (2, "x " + text[:5_000])], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in piece_lattice.encode(docs, PATH).select("doc_id", "n_tokens", "ids_crc32").collect()}
    for k, t in ((1, text), (2, "x " + text[:5_000])):
        ids, crc = want(t)
        assert got[k] == (len(ids), crc)


def test_units_and_spans_are_few(spark):
    """Units part where no piece holds two characters side by side, and substrings are looked up only as far as a piece begins like them."""
    merges = piece_lattice._load(PATH)
    together = {p[k : k + 2] for p in merges.ids for k in range(len(p) - 1)}
    for t in texts():
        for word in piece_lattice.words_of(t):
            units = merges.units(word)
            assert "".join(units) == word
            assert all(a[-1] + b[0] not in together for a, b in zip(units, units[1:]))
    apart = next(a + b for a in "qzxjv" for b in "qzxjv" if a + b not in together)  # letters that no piece holds side by side
    assert merges.units(f"▁{apart}") == [f"▁{apart[0]}", apart[1]] or "▁" + apart[0] not in together
    most = {r["head"]: r["most"] for r in piece_lattice.heads(spark, PATH).collect()}
    assert all(most[p[: piece_lattice.HEAD]] >= len(p) for p in merges.ids if len(p) >= piece_lattice.HEAD)
    assert max(most.values()) == merges.longest


def test_a_chunk_sends_its_units_in_one_row_a_home(spark):
    """Names go to the grouping many in a row, in order, and codes count through them."""
    texts = ["b a c a", "a  zz b", None, "x" * 200]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").coalesce(1)
    (row,) = piece_lattice._chunks(docs, public_tokenizers.path("piece_bpe_32k.model"), piece_lattice.Settings()).collect()
    homes = [p.home for p in row.packed]
    assert homes == sorted(set(homes)) and all(p.names.split(" ") == sorted(set(p.names.split(" "))) for p in row.packed)
    names, full = [n for p in row.packed for n in p.names.split(" ")], {x.name: x.text for x in row.long}
    units, at = [full.get(names[c], names[c]) for c in row.codes], 0
    for text, n in zip(texts, row.sizes, strict=True):
        assert "".join(units[at : at + n]) == "".join(piece_lattice.words_of(text))
        at += n


def test_units_are_cut_from_bytes_as_words_are():
    merges = piece_lattice._load(PATH)
    some = [*texts(), "  two  ", "▁▁x y▁", "é é", "日 本x 語", " ", "a b"]
    units, many = piece_lattice._units(pa.array(some), merges)
    units, at = [u.replace(" ", piece_lattice.SPACE) for u in units.to_pylist()], 0
    for t, n in zip(some, many.tolist(), strict=True):
        assert units[at : at + n] == [u for w in piece_lattice.words_of(t) for u in merges.units(w)]
        at += n
    assert at == len(units)


def test_a_chunk_names_its_units_once_and_codes_take_few_bytes(spark):
    """Of nine million characters of four units one row comes, with a byte for each code."""
    docs = spark.createDataFrame([(i, "ab cd ef " * 350_000) for i in range(3)], "id long, text string").coalesce(1)
    (row,) = piece_lattice._chunks(docs, PATH, piece_lattice.Settings()).collect()
    assert isinstance(row.codes, (bytes, bytearray)) and len(row.codes) == sum(row.sizes) == 3 * (3 * 350_000 + 1)
    assert sorted(n for p in row.packed for n in p.names.split(" ")) == ["▁", "▁ab", "▁cd", "▁ef"]


def test_the_lattice_stage_has_one_python_worker_a_task(spark, monkeypatch):
    """Each `mapInArrow` of a stage is a worker of its own beside it; texts go to Python in small batches, and the session keeps its settings."""
    units = spark.createDataFrame([(0, "▁a", "▁a", [(1, 2)])], f"home int, name string, text string, holders {piece_lattice.HOLDERS}")
    plan = piece_lattice.segment(units, PATH, piece_lattice.Settings())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before, kept_by = spark.conf.get(key), piece_lattice.kept_by
    monkeypatch.setattr(piece_lattice, "kept_by", lambda *a: (seen.append(spark.conf.get(key)), kept_by(*a))[1])
    piece_lattice.encode(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), PATH)
    assert seen == ["4m"] and spark.conf.get(key) == before
