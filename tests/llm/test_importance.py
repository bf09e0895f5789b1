import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lumenmart.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TEXTS = [
    "The quick brown fox, the quick brown fox", None, "", "a", "a b", "ÀÉ Straße x2y_z q\x7fend  --  ", "日本語 テキスト one\ttwo\nthree", "word " * 4000, "word " * 4000, "x" * 5000 + " " + "y" * 200,
    *("the quick brown fox jumps over the lazy dog " * (k % 4 + 2) + f"n{k} m{k % 5}" for k in range(60)),
]
TARGET = ["the lazy dog sleeps", None, "the lazy dog n3 jumps over", "Dog"]


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(docs, target, buckets=10000):
    """Rows (doc_id, n_features, weight, score, rank), written from the definition."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    source, wanted = Counter(bucket(f) for _, t in docs for f in features(t)[1]), Counter(bucket(f) for t in target for f in features(t)[1])
    big, small = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (big + buckets) / ((source[b] + 1) * (small + buckets)))) for b in range(buckets)]
    rows = []
    for i, t in docs:
        n, fs = features(t)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_equals_brute_force(spark):
    docs = [(3 * k, t) for k, t in enumerate(TEXTS)]
    got = importance.resample(
        spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, weight int, rank string").repartition(5), spark.createDataFrame([(t, 1) for t in TARGET], "text string, id int"),
    )
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, TARGET)


def test_equals_brute_force_on_documents(spark):
    docs, target = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    got = importance.resample(docs, target)
    assert sorted(map(tuple, got.collect()), key=str) == want and sum(r[4] is not None for r in want) > 20


def test_nulls_repeats_empty(spark):
    text = "one two three four five " * 5
    docs = [(None, text), (1, text), (1, text), (2, None), *((k, text + str(k)) for k in range(3, 40))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    target = spark.createDataFrame([("one two",)], "text string")
    assert sorted(map(tuple, importance.resample(df, target).collect()), key=str) == brute(docs, ["one two"])
    assert sorted(map(tuple, importance.resample(df, target.limit(0)).collect()), key=str) == brute(docs, [])
    assert importance.resample(df.limit(0), target).count() == 0


def test_ties_of_scores_go_to_smaller_ids(spark):
    scored = spark.createDataFrame([(i, i % 3) for i in range(1000)], "id long, score long")
    want = sorted(range(1000), key=lambda i: (-(i % 3), i))[:500]
    assert [r.id for r in sorted(importance.ranked(scored, 500).collect(), key=lambda r: r["rank"])] == want
    assert importance.ranked(scored, 5000).count() == 1000 and importance.ranked(scored, 0).count() == 0


@pytest.mark.parametrize("buckets", [10000, 64, 7])
def test_planes_give_exact_sums(buckets):
    rng = np.random.default_rng(buckets)
    counts = rng.integers(0, 5, (20, buckets)) * rng.integers(0, 1 << 20, (20, 1))
    gain = rng.integers(-20000, 9000, buckets)
    sliced, factors = importance.gain_planes(gain)
    for row, raw in zip(counts, importance.planes(counts), strict=True):
        own = np.frombuffer(raw, "<u8").reshape(-1, sliced.shape[1])
        assert sum(int(f) * int(np.bitwise_count(p & g).sum()) << k for k, p in enumerate(own) for g, f in zip(sliced, factors, strict=True)) == int(row @ gain)


def test_checksums_compose():
    rng = np.random.default_rng(0)
    parts = [(bytes(rng.integers(0, 256, int(n), dtype=np.uint8)), bytes(rng.integers(0, 256, int(m), dtype=np.uint8))) for n, m in rng.integers(0, 300, (200, 2))]
    a, b = (np.array([zlib.crc32(p[k]) for p in parts], np.uint32) for k in (0, 1))
    assert importance.joined(a, b, np.array([len(p[1]) for p in parts])).tolist() == [zlib.crc32(x + y) for x, y in parts]


def test_features_of_a_slice():
    texts = pa.array(["skip me", "a b c d", "", "e"]).slice(1)
    bucket, of, n_words, n_features = importance.features(texts, 10000)
    assert n_words.tolist() == [4, 0, 1] and n_features.tolist() == [9, 0, 1] and np.bincount(of, minlength=3).tolist() == [9, 0, 1]
    assert Counter(bucket[of == 0].tolist()) == Counter(zlib.crc32(f.encode()) % 10000 for f in features("a b c d")[1])


def test_no_kept_row_holds_many_documents(spark):
    """Readers hold thousands of rows at once, so a row is a document's planes or a chunk's totals."""
    docs = spark.createDataFrame([(k, f"a b{k} c") for k in range(600)] + [(None, None)], "doc_id int, text string").coalesce(1)
    rows = importance.counted(docs, "doc_id", "text", 64).toArrow()
    assert rows.num_rows == 602 and rows.column("totals").null_count == 601 and rows.column("planes").null_count == 1
    assert importance.totals(importance.counted(docs, "doc_id", "text", 64), 64).sum() == 600 * 6
