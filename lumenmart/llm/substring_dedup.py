"""Removal of repeated byte strings: every byte covered by a string of `length` bytes that also starts earlier in the corpus.

Suffixes that share their first `length` bytes must meet. A full suffix array would ship every suffix; here suffixes are cut into
buckets and only buckets that can hold a repeat are ever sorted. The bucket of a suffix is the smallest hash among the `gram`-byte
strings in its first `length` bytes, a cover of the text by its own content: equal strings choose equal buckets, and
neighbouring suffixes mostly share one, so that a run of some 35 suffixes is one row. (The README says why this cover stands in for the
arithmetic difference cover.) The steps:

1. each document is scanned once: its buckets, and the repeats within pieces of it, found by sorting the hashes of its suffixes;
2. buckets that occur once are dropped by a count; the others go back to their documents by a join;
3. those documents' runs get a digest of their bytes. Of equal runs all but the first are covered;
4. where one bucket holds several different runs (the edges of a repeat), their suffixes are sorted, one bucket after another. A bucket
   is dealt in salted parts of about `part` runs, so that no task holds a whole hot one; of equal suffixes of a part all but the first are
   covered, and the first ones of the parts of one bucket are combined by digest, at most one a part;
5. covered starts go back to their documents and the union of what they cover is cut out.

Counts and minima combine before they are shuffled; joins are plain equi-joins, which Spark splits at a hot key. Digests have 128
bits. Texts are worked on in pieces of bounded size, so memory is a piece, or one text for the final cut.

Defined results: null texts are empty; texts shorter than `length` are kept; null ids come after all others; rows that repeat an id are
ordered by a hash of their texts, and rows that repeat id and text are one document, given back as often as they came; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenmart.llm.common import kept, kept_by
from lumenmart.llm.near_dedup import _power, mixed

#: Bytes of a piece of a text, and bytes of runs that are sorted together.
PIECE, AT_ONCE = 1 << 20, 1 << 18
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    """part: different runs of a bucket that are sorted together, about."""

    length: int = 100
    gram: int = 28
    part: int = 4096


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbours, from running minima within blocks of w, both ways."""
    n = len(x) - w + 1
    blocks = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    forth = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], forth[w - 1 : w - 1 + n])


class Scan:
    """Runs of suffixes with one bucket in some pieces of texts, and the repeats within each piece."""

    def __init__(self, pieces: list[bytes], s: Settings):
        self.s, self.a = s, np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        n, none = len(self.a), np.empty(0, np.int64)
        self.piece = self.start = self.count = self.pos = self.of = none
        self.bucket = np.empty(0, np.uint64)
        if n < s.length:
            return
        up, self.down = _power(n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.a.astype(np.uint64) + np.uint64(1)) * up[:n])])
        grams = mixed((self.sums[s.gram :] - self.sums[: -s.gram]) * self.down[: n - s.gram + 1])
        least = sliding_minimum(grams, s.length - s.gram + 1)
        long = sizes >= s.length
        delta = np.zeros(n + 1, np.int64)
        np.add.at(delta, self.begins[long], 1)
        np.add.at(delta, self.ends[long] - s.length + 1, -1)
        self.pos = np.flatnonzero(np.cumsum(delta)[: n - s.length + 1])
        if not len(self.pos):
            return
        self.of = np.searchsorted(self.ends, self.pos, side="right")
        m = least[self.pos]
        at = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (self.pos[1:] != self.pos[:-1] + 1)])
        self.piece, self.bucket, self.count = self.of[at], m[at], np.diff(np.r_[at, len(m)])
        self.start = self.pos[at] - self.begins[self.piece]

    def repeats(self) -> dict[int, np.ndarray]:
        """By piece, the starts whose string starts earlier in the piece too."""
        if not len(self.pos):
            return {}
        s, pos = self.s, self.pos
        h = mixed((self.sums[pos + s.length] - self.sums[pos]) * self.down[pos])
        key = np.sort((self.of.astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12)))
        found = {}
        for p in np.unique(key[1:][key[1:] == key[:-1]] >> np.uint64(52)).astype(np.int64).tolist():
            i, j = np.searchsorted(self.of, [p, p + 1])
            order = i + np.argsort(h[i:j], kind="stable")
            pair = np.flatnonzero(h[order[1:]] == h[order[:-1]])
            later, earlier = pos[order[pair + 1]], pos[order[pair]]
            same = [
                (self.a[later[k : k + 20_000, None] + np.arange(s.length)] == self.a[earlier[k : k + 20_000, None] + np.arange(s.length)]).all(axis=1) for k in range(0, len(later), 20_000)
            ]
            if same and (good := np.concatenate(same)).any():
                found[p] = np.sort(later[good] - self.begins[p])
        return found


def _scans(texts: list[bytes], s: Settings) -> Iterator[tuple[list[tuple[int, int]], Scan]]:
    """Scans of some pieces at a time, with (text number, offset) of each piece; a piece has PIECE starts at most."""
    where, pieces, size = [], [], 0
    for k, text in enumerate(texts):
        for off in range(0, max(1, len(text) - s.length + 1), PIECE):
            piece = text[off : off + PIECE + s.length - 1]
            where.append((k, off)), pieces.append(piece)
            size += len(piece)
            if size > PIECE or len(pieces) >= 2000:
                yield where, Scan(pieces, s)
                where, pieces, size = [], [], 0
    if pieces:
        yield where, Scan(pieces, s)


def cut(text: bytes, covered: list[tuple[int, int]], length: int) -> tuple[int, int, str]:
    """Removed bytes, removed runs and the digest of what stays; covered: (first start, number of starts)."""
    if not covered:
        return 0, 0, hashlib.sha256(text).hexdigest()
    x = np.array(covered, np.int64)
    delta = np.zeros(len(text) + 1, np.int64)
    np.add.at(delta, x[:, 0], 1)
    np.add.at(delta, np.minimum(x[:, 0] + x[:, 1] + length - 1, len(text)), -1)
    gone = np.cumsum(delta)[:-1] > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), spans, hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()


def _texts(column: pa.Array) -> list[bytes]:
    return [(t.as_py() or "").encode() for t in column]


def _starts(x: np.ndarray) -> list[tuple[int, int]]:
    """Single starts as (first, number) of neighbours."""
    if not len(x):
        return []
    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1] + 1])
    return list(zip(x[at].tolist(), np.diff(np.r_[at, len(x)]).tolist(), strict=True))


def _own_repeats(texts: list[bytes], s: Settings) -> tuple[list[list[tuple[int, int]]], list[np.ndarray]]:
    """Of each text, what repeats within its pieces, and its buckets (once a piece)."""
    covered, buckets = [[] for _ in texts], [[] for _ in texts]
    for where, scan in _scans(texts, s):
        for p, starts in scan.repeats().items():
            k, off = where[p]
            covered[k] += _starts(starts + off)
        cuts = np.searchsorted(scan.piece, np.arange(len(where) + 1))
        for p, (k, _) in enumerate(where):
            if cuts[p + 1] > cuts[p]:
                buckets[k].append(np.unique(scan.bucket[cuts[p] : cuts[p + 1]]))
    return covered, [np.concatenate(b) if b else np.empty(0, np.uint64) for b in buckets]


def _scan_documents(rows: DataFrame, s: Settings) -> DataFrame:
    """oid, content, the result of repeats within pieces, and the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                texts = _texts(part.column(2))
                covered, buckets = _own_repeats(texts, s)
                removed, spans, sha = zip(*(cut(t, c, s.length) for t, c in zip(texts, covered, strict=True)), strict=True)
                offsets = pa.array(np.cumsum([0, *map(len, buckets)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(buckets).view(np.int64)))
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), sizes, pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha), lists],
                    names=["oid", "content", "n_bytes", "n_removed", "n_spans", "kept_sha256", "buckets"],
                )

    return rows.mapInArrow(run, "oid long, content long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, buckets array<long>")


def _runs(suspects: DataFrame, s: Settings) -> DataFrame:
    """suspects: oid, content, text, wanted. The runs in wanted buckets: bucket, digest, oid, content, start, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, oid, content = _texts(b.column(2)), b.column(0).to_numpy(), b.column(1).to_numpy()
            wanted = [np.sort(x.values.to_numpy()) for x in b.column(3)]
            for where, scan in _scans(texts, s):
                k = np.array([w[0] for w in where])
                hit = np.zeros(len(scan.piece), bool)
                cuts = np.searchsorted(scan.piece, np.arange(len(where) + 1))
                bucket = scan.bucket.view(np.int64)
                for p in range(len(where)):
                    i, j = cuts[p], cuts[p + 1]
                    if j > i:
                        hit[i:j] = np.isin(bucket[i:j], wanted[k[p]])
                at = np.flatnonzero(hit)
                if not len(at):
                    continue
                piece, count = scan.piece[at], scan.count[at]
                first = scan.begins[piece] + scan.start[at]
                raw = scan.a.tobytes()
                digests = [xxhash.xxh3_128_digest(raw[i:j]) for i, j in zip(first.tolist(), (first + count + s.length - 1).tolist(), strict=True)]
                start = scan.start[at] + np.array([w[1] for w in where])[piece]
                cols = [pa.array(bucket[at]), pa.array(digests, pa.binary()), pa.array(oid[k[piece]]), pa.array(content[k[piece]]), pa.array(start), pa.array(count)]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "digest", "oid", "content", "start", "n"])

    return suspects.mapInArrow(run, "bucket long, digest binary, oid long, content long, start long, n long")


def _contexts(asked: DataFrame, s: Settings) -> DataFrame:
    """asked: oid, content, text, runs (bucket, start, n). The runs' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 200):
                part, rows = b.slice(a, 200), []
                for oid, content, text, runs in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _texts(part.column(2)), part.column(3).to_pylist(), strict=True):
                    rows += [(r["bucket"], oid, content, r["start"], text[r["start"] : r["start"] + r["n"] + s.length - 1]) for r in runs]
                if rows:
                    cols = zip(*rows, strict=True)
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "oid", "content", "start", "bytes"])

    return asked.mapInArrow(run, "bucket long, oid long, content long, start long, bytes binary")


SETTLED = "bucket long, suffix binary, oid long, content long, start long, n long"


def _repeated(a: np.ndarray, pos: np.ndarray, of: np.ndarray, length: int) -> np.ndarray:
    """Whether the string at each of the positions is also at an earlier one with the same `of`."""
    up, down = _power(len(a) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)])])
    h = mixed(mixed((sums[pos + length] - sums[pos]) * down[pos]) + of.astype(np.uint64))
    order = np.argsort(h, kind="stable")
    pair = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    later, earlier, again = order[pair + 1], order[pair], np.zeros(len(pos), bool)
    for k in range(0, len(pair), 20_000):
        x, y = later[k : k + 20_000], earlier[k : k + 20_000]
        same = (of[x] == of[y]) & (a[pos[x, None] + np.arange(length)] == a[pos[y, None] + np.arange(length)]).all(axis=1)
        if not same.all():  # two strings with one hash: compare the strings themselves
            seen: set[tuple[int, bytes]] = set()
            raw = a.tobytes()
            return np.array([(w := (o, raw[p : p + length])) in seen or bool(seen.add(w)) for o, p in zip(of.tolist(), pos.tolist(), strict=True)])
        again[x] = True
    return again


def _settle(rows: list[tuple], s: Settings) -> pa.RecordBatch:
    """rows: bucket, salt, parts, oid, content, start, bytes of whole parts. Covered starts as runs; of buckets of several parts, also the suffixes not covered."""
    rows.sort(key=lambda r: (r[0], r[1], r[3], r[4], r[5]))
    sizes = np.array([len(r[6]) for r in rows], np.int64)
    begins, many = np.cumsum(sizes) - sizes, sizes - s.length + 1
    raw = b"".join(r[6] for r in rows)
    row = np.repeat(np.arange(len(rows)), many)
    pos = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + begins[row]
    new = [k == 0 or rows[k][:2] != rows[k - 1][:2] for k in range(len(rows))]
    again = _repeated(np.frombuffer(raw, np.uint8), pos, np.cumsum(new)[row], s.length)
    at = np.flatnonzero(again)
    first = at[np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])][: len(at)])]
    n = np.diff(np.append(np.searchsorted(at, first), len(at)))
    open_ = np.flatnonzero(~again & np.array([r[2] > 1 for r in rows], bool)[row])
    k = np.concatenate([first, open_])
    of = row[k]
    column = lambda c: pa.array(np.array([r[c] for r in rows], np.int64)[of])
    digests = [None] * len(first) + [xxhash.xxh3_128_digest(raw[p : p + s.length]) for p in pos[open_].tolist()]
    starts = np.array([r[5] for r in rows], np.int64)[of] + pos[k] - begins[of]
    return pa.RecordBatch.from_arrays(
        [column(0), pa.array(digests, pa.binary()), column(3), column(4), pa.array(starts), pa.array(np.concatenate([n, np.ones(len(open_), np.int64)]))],
        names=["bucket", "suffix", "oid", "content", "start", "n"],
    )


def _sort_buckets(contexts: DataFrame, s: Settings) -> DataFrame:
    """contexts: bucket, different, oid, content, start, bytes. The covered starts: oid, content, start, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, closed = 0, 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[-1][:2] != row[:2]:
                    closed = len(held)
                    if size > AT_ONCE:
                        yield _settle(held[:closed], s)
                        held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield _settle(held, s)

    parts = F.ceil(F.col("different") / F.lit(s.part))
    dealt = contexts.withColumn("parts", parts).withColumn("salt", F.pmod(F.xxhash64("bytes"), F.col("parts")))
    dealt = dealt.select("bucket", "salt", "parts", "oid", "content", "start", "bytes").repartition("bucket", "salt").sortWithinPartitions("bucket", "salt")
    settled = kept(dealt.mapInArrow(run, SETTLED), "settled")
    winners = settled.filter("suffix IS NOT NULL")
    here = F.struct("oid", "content", "start")
    first = winners.groupBy("bucket", "suffix").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").select("bucket", "suffix", "first")
    again = winners.join(first, ["bucket", "suffix"]).filter(here != F.col("first"))
    return settled.filter("suffix IS NULL").select("oid", "content", "start", "n").unionByName(again.select("oid", "content", "start", "n"))


def _cut(suspects: DataFrame, s: Settings) -> DataFrame:
    """suspects: oid, content, text, covered. The result of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                texts, covered = _texts(part.column(2)), part.column(3)
                own, _ = _own_repeats(texts, s)
                got = [cut(t, mine + [(c["start"], c["n"]) for c in (more.as_py() or [])], s.length) for t, mine, more in zip(texts, own, covered, strict=True)]
                removed, spans, sha = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)], names=["oid", "content", "removed", "spans", "sha"])

    return suspects.mapInArrow(run, "oid long, content long, removed long, spans long, sha string")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row for each row of docs."""
    s = settings or Settings()
    oid, content = docs[id_col].cast("long"), F.xxhash64(docs[text_col])
    # The sign tells rows without an id from those with the largest one, and puts them last.
    content = F.when(oid.isNull(), content.bitwiseAND(F.lit(LAST))).otherwise(content.bitwiseOR(F.lit(-LAST - 1)))
    rows = docs.select(F.coalesce(oid, F.lit(LAST)).alias("oid"), content.alias("content"), docs[text_col].alias("text"))
    scanned = kept(_scan_documents(rows, s), "scanned")
    each = scanned.select("oid", "content", F.explode("buckets").alias("bucket"))
    shared = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("bucket")
    wanted = each.join(shared, "bucket").groupBy("oid", "content").agg(F.collect_set("bucket").alias("wanted"))
    suspects = kept_by(rows.join(wanted, ["oid", "content"]), "suspects", "oid", "content")
    runs = kept(_runs(suspects.select("oid", "content", "text", "wanted"), s), "runs")
    firsts = kept(runs.groupBy("digest").agg(F.min(F.struct("oid", "content", "start", "n", "bucket")).alias("first")), "firsts")
    here = F.struct("oid", "content", "start")
    there = F.struct("first.oid", "first.content", "first.start")
    copies = runs.select("digest", "oid", "content", "start", "n").join(firsts, "digest").filter(here != there).select("oid", "content", "start", "n")
    ragged = firsts.select("first.*").groupBy("bucket").agg(F.count(F.lit(1)).alias("different")).filter("different > 1")
    asked = firsts.select("first.*").join(ragged, "bucket").groupBy("oid", "content").agg(F.collect_list(F.struct("bucket", "start", "n")).alias("asked"))
    texts = suspects.select("oid", "content", "text").join(asked, ["oid", "content"]).select("oid", "content", "text", "asked")
    contexts = kept(_contexts(texts, s).distinct().join(ragged, "bucket"), "contexts")
    covered = copies.unionByName(_sort_buckets(contexts, s)).groupBy("oid", "content").agg(F.collect_list(F.struct("start", "n")).alias("covered"))
    final = _cut(suspects.select("oid", "content", "text").join(covered, ["oid", "content"]), s)
    final = final.groupBy("oid", "content").agg(F.first("removed").alias("removed"), F.first("spans").alias("spans"), F.first("sha").alias("sha"))
    return scanned.drop("buckets").join(final, ["oid", "content"], "left").select(
        F.when((F.col("oid") != LAST) | (F.col("content") < 0), F.col("oid")).alias("doc_id"), "n_bytes", F.coalesce("removed", "n_removed").alias("n_removed"),
        F.coalesce("spans", "n_spans").alias("n_spans"), F.coalesce("sha", "kept_sha256").alias("kept_sha256"),
    )
