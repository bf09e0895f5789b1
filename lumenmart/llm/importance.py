"""Importance resampling towards a target, by bit-sliced aggregation.

A document's features (runs of 1 to 3 words) are counted by bucket, crc32 of the feature modulo `buckets`. The counts are kept as bit planes: bit b of plane k is
bit k of the count of bucket b, so a document has as many planes as its largest count has bits. Buckets' gains, which follow from the totals of both
tables, are integers and become planes in two's complement. A document's weight is then exact:

    sum over k and j of 2^(k+j) * popcount(plane k AND gain plane j), the gains' last plane with the sign minus

One pass over the texts makes planes and totals (kept as Parquet, a row a document and a row of totals a chunk); the totals of all chunks are `buckets` rows and pass through the driver; a
second pass reads planes, not texts. Features' checksums come from those of words: crc32 is linear, so the checksum of `u v` is that of `u`, shifted by the
length of ` v`, xor that of ` v`; the shift of a whole array is four table look-ups.

The draw is exact at any size: a histogram of scores finds the bin that holds the last drawn one, and only documents in or above it are ranked, by ranges
of (score, id) that are numbered each by itself.

Defined results: a null or empty text has no words, weight 0 and is never drawn; null ids are hashed as an empty text and come first among ties; repeated
ids are rows of their own, equal ones in any order; empty tables have no features (an empty target gives gains from its pseudo counts alone); extra columns
are ignored; texts of any length are one row's work: their counts grow, not the planes' width.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumenmart.llm.chunks import chunks, grouped_sum, places
from lumenmart.llm.common import kept

CHUNK, ROWS = 4 << 20, 2048
#: Documents whose counts are held as one matrix.
BLOCK = 128
#: Lengths whose shifts are held as tables; longer ones are composed of them.
LONGEST = 64
#: What each byte becomes: digits, letters (small) and all bytes beyond ASCII stay, all else parts words.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """[n, k, v]: what byte k of value v of a checksum contributes once n more zero bytes have passed (a linear map, taken at its unit values)."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # the table of one byte's step
    table = np.zeros((LONGEST + 1, 4, 256), np.uint32)
    for k in range(4):
        table[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, LONGEST + 1):
        table[n] = one[table[n - 1] & 0xFF] ^ (table[n - 1] >> np.uint32(8))
    return table


def joined(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of a + b from those of a and of b, and b's length in bytes."""
    table, out, rest = _shifts(), left, length
    while True:
        n = np.minimum(rest, LONGEST)
        out = table[n, 0, out & 0xFF] ^ table[n, 1, (out >> 8) & 0xFF] ^ table[n, 2, (out >> 16) & 0xFF] ^ table[n, 3, out >> 24]
        rest = rest - n
        if not rest.any():
            return out ^ right


def _words(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Codes of all words, what they stand for, and where each text's begin and end."""
    _, offsets, data = texts.buffers()
    data = pa.py_buffer(data.to_pybytes().translate(WORD_BYTES)) if data is not None else data
    plain = pa.Array.from_buffers(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary(), len(texts), [None, offsets, data], offset=texts.offset)
    split = pc.split_pattern(plain, b" ")
    coded = split.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    there = np.array([len(w) > 0 for w in words], bool)[codes] if len(codes) else np.empty(0, bool)
    return codes[there], words, places(grouped_sum(there, places(pc.list_value_length(split).to_numpy(zero_copy_only=False))))


def features(texts: pa.Array, buckets: int, longest: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each feature and the text that it is of; and each text's numbers of words and of features."""
    codes, words, ends = _words(texts)
    alone = np.array([zlib.crc32(w) for w in words], np.uint32)
    spaced = np.array([zlib.crc32(b" " + w) for w in words], np.uint32)
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    n = np.diff(ends)
    of = np.repeat(np.arange(len(n)), n)
    crc, texts_of, found = (alone[codes] if len(codes) else np.empty(0, np.uint32)), of, []
    for size in range(1, longest + 1):
        if size > 1:  # runs of one word less, each with the word behind it
            last, inside = codes[size - 1 :], of[: len(of) - size + 1] == of[size - 1 :]
            crc = joined(crc[:-1][: len(last)], spaced[last], sizes[last]) if len(last) else np.empty(0, np.uint32)
            texts_of, kept_crc = of[: len(last)][inside[: len(last)]], crc[inside[: len(last)]]
        else:
            kept_crc = crc
        found.append((kept_crc % np.uint32(buckets), texts_of))
    return np.concatenate([b for b, _ in found]).astype(np.int64), np.concatenate([t for _, t in found]), n, sum(np.maximum(n - k, 0) for k in range(longest))


def width(buckets: int) -> int:
    """Bytes of a plane: whole 64-bit words."""
    return -(-buckets // 64) * 8


def planes(matrix: np.ndarray) -> list[bytes]:
    """Counts, a row a document: its planes, lowest first."""
    size, n = width(matrix.shape[1]), matrix.max(axis=1, initial=0)
    bits = np.array([int(x).bit_length() for x in n])
    out: list[list[bytes]] = [[] for _ in n]
    for k in range(int(bits.max(initial=0))):
        rows = np.flatnonzero(bits > k)
        packed = np.zeros((len(rows), size), np.uint8)
        one = np.packbits((matrix[rows] >> k) & 1 != 0, axis=1, bitorder="little")
        packed[:, : one.shape[1]] = one
        for r, p in zip(rows.tolist(), packed, strict=True):
            out[r].append(p.tobytes())
    return [b"".join(x) for x in out]


def counted(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """A row for each document: id, n_words, n_features, planes; and one for each chunk, with totals (array of long, one a bucket) alone. No row is larger than a document's
    planes, since readers hold thousands of rows at once."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("n_words", pa.int64()), ("n_features", pa.int64()), ("planes", pa.binary()), ("totals", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, CHUNK, ROWS):
            bucket, of, n_words, n_features = features(texts, buckets)
            order = np.argsort(of, kind="stable")
            bucket, cuts = bucket[order], places(n_features)
            sliced = []
            for a in range(0, len(ids), BLOCK):
                z = min(len(ids), a + BLOCK)
                keys = bucket[cuts[a] : cuts[z]] + np.repeat(np.arange(z - a), n_features[a:z]) * buckets
                sliced += planes(np.bincount(keys, minlength=(z - a) * buckets).reshape(z - a, buckets))
            yield pa.RecordBatch.from_arrays([ids.cast(schema.types[0]), pa.array(n_words), pa.array(n_features), pa.array(sliced, pa.binary()), pa.nulls(len(ids), schema.types[4])], schema=schema)
            one = pa.ListArray.from_arrays(pa.array([0, buckets], pa.int32()), pa.array(np.bincount(bucket, minlength=buckets)))
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in schema.types[:4]), one], schema=schema)

    return rows.mapInArrow(run, f"id {kind.simpleString()}, n_words long, n_features long, planes binary, totals array<long>")


def totals(chunked: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket: one row a bucket comes to the driver."""
    out = np.zeros(buckets, np.int64)
    for r in chunked.filter("totals IS NOT NULL").select(F.posexplode("totals").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln of the ratio of smoothed shares), a bucket each."""
    n, s, t = float(len(source)), source.astype(float), target.astype(float)
    return np.floor(scale * np.log(((t + 1) * (s.sum() + n)) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Planes of the gains in two's complement, as 64-bit words, and each plane's factor."""
    bits = max(int(max(gain.max(initial=0), -1 - gain.min(initial=0))).bit_length(), 1)
    packed = np.zeros((bits + 1, width(len(gain))), np.uint8)
    for j in range(bits + 1):
        one = np.packbits((gain >> j) & 1 != 0, bitorder="little")
        packed[j, : len(one)] = one
    return packed.view("<u8"), np.array([1 << j for j in range(bits)] + [-(1 << bits)], np.int64)


def weigh(chunked: DataFrame, gain: np.ndarray) -> DataFrame:
    """id, n_words, n_features, weight of each document."""
    sliced, factors = gain_planes(gain)
    rows = chunked.filter("totals IS NULL").select("id", "n_words", "n_features", "planes")
    kind = rows.schema["id"].dataType.simpleString()
    size = sliced.shape[1] * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = pc.binary_length(b.column(3)).to_numpy(zero_copy_only=False) // size
            ends = places(lengths)
            flat = np.frombuffer(b"".join(b.column(3).to_pylist()), "<u8").reshape(-1, sliced.shape[1])
            each = np.zeros(len(flat), np.int64)
            for a in range(0, len(flat), 512):
                some = flat[a : a + 512]
                for plane, factor in zip(sliced, factors.tolist(), strict=True):
                    each[a : a + 512] += factor * np.bitwise_count(some & plane).sum(axis=1, dtype=np.int64)
            each <<= np.arange(len(flat)) - np.repeat(ends[:-1], lengths)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(grouped_sum(each, ends))], names=["id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, n: int, score: str = "score", key: str = "id") -> DataFrame:
    """The n rows of highest score (fewer if there are fewer), ties to the smaller key, with `rank` from 1."""
    spark, bins = scored.sparkSession, 4096
    lo, hi = scored.agg(F.min(score), F.max(score)).first()
    if lo is None or n < 1:
        return scored.limit(0).withColumn("rank", F.lit(None).cast("long"))
    step = max(1, -(-(hi - lo + 1) // bins))
    of_bin = F.floor((F.col(score) - F.lit(lo)) / F.lit(step)).cast("int")
    sizes, above, edge = {r.bin: r.many for r in scored.groupBy(of_bin.alias("bin")).agg(F.count(F.lit(1)).alias("many")).collect()}, 0, lo  # at most `bins` rows
    for b in sorted(sizes, reverse=True):
        above += sizes[b]
        if above >= n:
            edge = lo + b * step
            break
    some, parts = scored.filter(F.col(score) >= F.lit(edge)), max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = kept(some.repartitionByRange(parts, F.desc(score), F.asc(key)).withColumn("_lm_block", F.spark_partition_id()), "ranked")
    counts = ranged.groupBy("_lm_block").agg(F.count(F.lit(1)).alias("_lm_n"))  # one row a range
    before = counts.select("_lm_block", (F.sum("_lm_n").over(Window.partitionBy(F.lit(0)).orderBy("_lm_block")) - F.col("_lm_n")).alias("_lm_before"))
    within = F.row_number().over(Window.partitionBy("_lm_block").orderBy(F.desc(score), F.asc(key)))
    found = ranged.withColumn("_lm_within", within).join(F.broadcast(before), "_lm_block").withColumn("rank", (F.col("_lm_before") + F.col("_lm_within")).cast("long"))
    return found.filter(F.col("rank") <= n).drop("_lm_block", "_lm_within", "_lm_before")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", buckets: int = 10_000,
    percent: int = 5, least_words: int = 20, seed: int = 42,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null where not drawn): one row for each row of docs."""
    source = kept(counted(docs, id_col, text_col, buckets), "planes")
    wanted = counted(target.withColumn("_lm_none", F.lit(0)), "_lm_none", target_text, buckets)
    weighed = weigh(source, gains(totals(source, buckets), totals(wanted, buckets)))
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((hashed + 0.5) / 4294967296.0))).cast("long")
    # Rows get numbers of their own, since ids may be null or repeat.
    scored = kept(weighed.withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()), "weights")
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = ranked(able.select("id", "score", "row"), percent * able.count() // 100)
    return scored.join(drawn.select("row", "rank"), "row", "left").select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
