"""Alignment of two tokenizers' tokens, with corpus-wide counts of linked pairs from inverted bitmaps.

Tokens of both tokenizers cover the same bytes. Where tokens of both end, a group ends; a token of A is linked with each token of B whose bytes it shares.

1. One pass over the texts aligns each different word once (spaces part words for both tokenizers; texts where they might not are aligned whole) and inverts
   each chunk of up to `BLOCK` documents: a pair of ids gets compressed bitmaps over the chunk's documents, one for each bit of how often it is linked there
   (multiplicity planes). A compressed bitmap is a sorted array of 16-bit places, or plain bits where that is shorter. A row a chunk is kept.
2. A pair's planes are merged by OR and popcounted: the chunk's documents that hold the pair. Chunks hold different documents, so the union over chunks is
   disjoint, and a pair's counts are summed, combined before the shuffle. The best count of each A id is joined from a table of at most vocabulary size.
3. The postings return scores: 2^k times a pair's score for each place in its plane k. The most frequent pairs' scores are broadcast (a bounded table) and
   summed where the chunk is read; the other pairs' postings are joined with their scores and summed by document.

Defined results: a null or empty text, and one whose tokens don't give back its bytes, has no tokens: zeros and an empty digest; null and repeated ids are
documents like others, each row for itself; ties for the best count all count; an empty table gives an empty result; extra columns are ignored; a text longer
than a chunk is a chunk of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumenmart.llm.chunks import Remembered, Spaced, SpacedIds, chunks, expanded, grouped_sum, places
from lumenmart.llm.common import kept

CHUNK, BLOCK = 4 << 20, 4096
#: Bytes of a plain bitmap; arrays of places are shorter.
PLAIN = BLOCK // 8
MARK = "▁"


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


class Side:
    """Bytes of each id, flat."""

    def __init__(self, raw: list[bytes]):
        self.at, self.flat = places([len(x) for x in raw]), b"".join(raw)
        self.sizes = np.diff(self.at)
        text = [str(i).encode() for i in range(len(raw))]
        self.signed = {c: np.array([c + t for t in text], object) for c in (b";", b"|", b",")}

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.flat, np.uint8)[expanded(ids, self.at)]


class Aligner:
    """Aligns words; a word's record is (n_a, n_b, n_groups, links as pairs, groups as text), or None where bytes differ."""

    SEPARATE = 2000

    def __init__(self, path_a: str, path_b: str, most: int = 300_000):
        import sentencepiece

        self.spaced = SpacedIds(path_a, most)
        vocabulary, to_byte = self.spaced.tokenizer.get_vocab(), byte_level()
        raw = [b""] * self.spaced.width
        for token, i in vocabulary.items():
            raw[i] = bytes([to_byte[c] for c in token]) if all(c in to_byte for c in token) else token.encode()
        self.a = Side(raw)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.b = Side([bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)])
        self.opens = np.array([p.startswith(MARK) for p in names])
        self.known = Remembered(self.align, most)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B, and where each word's begin."""
        raw = self.spaced.of(words)
        a, a_at = np.frombuffer(b"".join(raw), self.spaced.kind).astype(np.int64), places([len(x) // self.spaced.kind.itemsize for x in raw])
        b = np.array(self.pieces.encode(" ".join(words)), np.int64)
        b_at = np.append(np.flatnonzero(self.opens[b]), len(b))
        if len(b_at) != len(words) + 1:  # a mark within a word
            each = self.pieces.encode(words)
            b, b_at = np.array([i for x in each for i in x], np.int64), places([len(x) for x in each])
        return a, a_at, b, b_at

    def align(self, words: list[str]) -> list:
        return [r for k in range(0, len(words), self.SEPARATE) for r in self._align(words[k : k + self.SEPARATE])]

    def _align(self, words: list[str]) -> list:
        a, a_at, b, b_at = self._ids(words)
        text = np.frombuffer((" " + " ".join(words)).encode(), np.uint8)
        if not all(np.array_equal(side.bytes_of(ids), text) for side, ids in ((self.a, a), (self.b, b))):
            if len(words) == 1:
                return [None]
            half = len(words) // 2
            return self._align(words[:half]) + self._align(words[half:])
        a_end, b_end = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        a_cut, b_cut = np.isin(a_end, b_end), np.isin(b_end, a_end)
        a_group, b_group = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        groups = np.append(0, np.cumsum(a_cut))[a_at]
        lo, hi = np.searchsorted(b_end, a_end - self.a.sizes[a], side="right"), np.searchsorted(b_end - self.b.sizes[b], a_end)
        many = hi - lo
        pairs = (np.repeat(a, many) << 32) | b[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        links = places(many)[a_at]
        # Both sides' ids in the order of groups, A's before B's.
        a_first, b_first = np.append(True, a_cut[:-1]), np.append(True, b_cut[:-1])
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = np.where(a_first, self.a.signed[b";"][a], self.a.signed[b","][a])
        out[np.arange(len(b)) + np.searchsorted(a_group, b_group, side="right")] = np.where(b_first, self.b.signed[b"|"][b], self.b.signed[b","][b])
        out, at, raw = out.tolist(), (a_at + b_at).tolist(), pairs.tobytes()
        n_a, n_b, n_g, l_at = np.diff(a_at).tolist(), np.diff(b_at).tolist(), np.diff(groups).tolist(), (8 * links).tolist()
        return [(n_a[k], n_b[k], n_g[k], raw[l_at[k] : l_at[k + 1]], b"".join(out[at[k] : at[k + 1]])) for k in range(len(words))]

    def whole(self, text: str):
        """The record of a text that isn't cut at spaces."""
        a = np.frombuffer(self.spaced.raw([" " + text])[0], self.spaced.kind).astype(np.int64)
        b = np.array(self.pieces.encode(text), np.int64)
        keep, self._ids = self._ids, lambda _: (a, np.array([0, len(a)]), b, np.array([0, len(b)]))
        try:
            return self._align([text])[0]
        finally:
            self._ids = keep


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def packed(of: np.ndarray, place: np.ndarray, n: int) -> pa.Array:
    """Compressed bitmaps 0 to n - 1 from (bitmap, place) sorted by both."""
    counts = np.bincount(of, minlength=n)
    plain = 2 * counts >= PLAIN
    at = places(np.where(plain, PLAIN, 2 * counts))
    out = np.zeros(int(at[-1]), np.uint8)
    some = ~plain[of]
    rank = np.arange(len(of)) - (np.cumsum(counts) - counts)[of]
    out.view("<u2")[at[of[some]] // 2 + rank[some]] = place[some]
    np.bitwise_or.at(out, at[of[~some]] + (place[~some] >> 3), (1 << (place[~some] & 7)).astype(np.uint8))
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


def unpacked(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap, place) of every bit."""
    sizes = pc.binary_length(bitmaps).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, at = np.frombuffer(b"".join(bitmaps.to_pylist()), np.uint8), places(sizes)
    sparse, plain = np.flatnonzero(sizes < PLAIN), np.flatnonzero(sizes == PLAIN)
    n = sizes[sparse] // 2
    first = at[sparse] // 2
    place = flat.view("<u2")[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int64)
    row, bit = np.nonzero(np.unpackbits(flat[(at[plain][:, None] + np.arange(PLAIN))], axis=1, bitorder="little")) if len(plain) else (np.empty(0, np.int64),) * 2
    return np.concatenate([np.repeat(sparse, n), plain[row]]), np.concatenate([place, bit])


def inverted(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """A row for each chunk: chunk (its number), docs (id and figures of each document), pairs (ascending), and the planes: of (place in pairs), plane, bits."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType
    doc = pa.struct([("id", to_arrow_type(kind)), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())])
    lists = {"docs": doc, "pairs": pa.int64(), "of": pa.int32(), "plane": pa.int32(), "bits": pa.binary()}
    schema = pa.schema([("chunk", pa.int64()), *((n, pa.list_(t)) for n, t in lists.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for ids, texts in chunks(batches, CHUNK, BLOCK):
            cut = Spaced(texts)
            n, known = len(ids), len(cut.words)
            empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
            odd = np.flatnonzero((cut.odd | cut.leading) & ~empty)
            nothing = (0, 0, 0, b"", b"")
            records = [*own.known.of(cut.plain), *(own.whole(texts[int(k)].as_py()) for k in odd), nothing]
            codes, sizes = cut.codes.copy(), np.diff(cut.ends)
            codes[np.repeat(cut.odd | cut.leading | empty, sizes)] = known + len(odd)
            codes[cut.first[odd]] = known + np.arange(len(odd))
            wrong = grouped_sum(np.array([r is None for r in records])[codes], cut.ends) > 0
            codes[np.repeat(wrong, sizes)] = known + len(odd)
            records = [r or nothing for r in records]
            n_a, n_b, n_groups, links, groups = zip(*records, strict=True)
            n_links = np.array([len(x) // 8 for x in links], np.int64)
            figures = [grouped_sum(np.array(x, np.int64)[codes], cut.ends) for x in (n_a, n_b, n_groups, n_links)]
            ends, all_codes = cut.ends.tolist(), codes.tolist()
            joined = [b"".join([groups[c] for c in all_codes[a:z]])[1:] for a, z in zip(ends, ends[1:], strict=False)]
            digests = [hashlib.sha256(x).hexdigest() if x else "" for x in joined]
            # Each document's different words, then their pairs, then (pair, document) with the number of links.
            word_of, times = np.unique(np.repeat(np.arange(n), sizes) * len(records) + codes, return_counts=True)
            d, w = np.divmod(word_of, len(records))
            pairs, local = np.unique(np.frombuffer(b"".join(links), "<i8"), return_inverse=True)
            at = places(n_links)
            key = local[expanded(w, at)] * BLOCK + np.repeat(d, n_links[w])
            times = np.repeat(times, n_links[w])
            order = np.argsort(key)
            key, times = key[order], times[order]
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
            key, times = key[begin], np.add.reduceat(times, begin) if len(key) else times
            pair, place = np.divmod(key, BLOCK)
            of, plane, bits = [], [], []
            for k in range(int(times.max(initial=0)).bit_length()):
                some = (times >> k) & 1 != 0
                there, back = np.unique(pair[some], return_inverse=True)
                of.append(there), plane.append(np.full(len(there), k)), bits.append(packed(back, place[some], len(there)))
            there = np.unique(pair)  # a pair may belong to words of left-out documents only
            of = np.searchsorted(there, np.concatenate(of)) if of else np.empty(0, np.int64)
            values = {
                "docs": pa.StructArray.from_arrays([ids, *map(pa.array, figures), pa.array(digests, pa.string())], fields=list(doc)), "pairs": pa.array(pairs[there], pa.int64()), "of": pa.array(of.astype(np.int32)),
                "plane": pa.array((np.concatenate(plane) if plane else of).astype(np.int32)), "bits": pa.chunked_array(bits, pa.binary()).combine_chunks(),
            }
            yield pa.RecordBatch.from_arrays([pa.array([number]), *(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values.values())], schema=schema)
            number += 1

    figures = ",".join(f"{c}:long" for c in ("n_a", "n_b", "n_groups", "n_links"))
    return rows.mapInArrow(run, f"chunk long, docs array<struct<id:{kind.simpleString()},{figures},groups_sha256:string>>, pairs array<long>, of array<int>, plane array<int>, bits array<binary>")


def pair_counts(chunked: DataFrame) -> DataFrame:
    """pair, n: documents that hold the pair linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                pairs, of, bits = (c[k].values for c in b.columns)
                bitmap, place = unpacked(bits)
                merged = np.unique(of.to_numpy()[bitmap].astype(np.int64) * BLOCK + place)  # OR of the planes
                yield pa.RecordBatch.from_arrays([pairs, pa.array(np.bincount(merged // BLOCK, minlength=len(pairs)))], names=["pair", "n"])

    return chunked.select("pairs", "of", "bits").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def scores(chunked: DataFrame) -> DataFrame:
    """pair, n, best (whether no pair of its A id has a higher count)."""
    counts = kept(pair_counts(chunked), "pairs").withColumn("a", F.shiftright("pair", 32))
    best = counts.groupBy("a").agg(F.max("n").alias("most"))  # at most as many rows as the vocabulary
    return counts.join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = 200_000) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row for each row of docs. frequent: pairs in the broadcast table."""
    spark = docs.sparkSession
    chunked = kept(inverted(docs, path_a, path_b, id_col, text_col), "postings")
    scored = kept(scores(chunked), "scores")
    top = scored.orderBy(F.desc("n"), "pair").limit(frequent).toArrow().sort_by("pair")
    table = spark.sparkContext.broadcast([top.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in range(3)])

    def found(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, n, best = table.value
        at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
        there = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
        return there, np.where(there, n[at], 0) if len(keys) else np.zeros(len(pairs), np.int64), there & best[at] if len(keys) else there

    def postings(of: pa.Array, plane: pa.Array, bits: pa.Array, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pair, document and number of links, for the pairs wanted; a document comes once for each plane."""
        of, plane = of.to_numpy(), plane.to_numpy()
        some = np.flatnonzero(wanted[of])
        bitmap, place = unpacked(bits.take(pa.array(some)))
        return of[some][bitmap], place, np.int64(1) << plane[some][bitmap].astype(np.int64)

    def frequent_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                each, pairs, of, plane, bits = (c[k].values for c in b.columns[1:])
                there, n, best = found(pairs.to_numpy())
                pair, place, links = postings(of, plane, bits, there)
                n_best, count_sum = np.zeros(len(each), np.int64), np.zeros(len(each), np.int64)
                np.add.at(count_sum, place, links * n[pair])
                np.add.at(n_best, place, links * best[pair])
                key = (b.column(0)[k].as_py() << 12) + np.arange(len(each))
                yield pa.RecordBatch.from_arrays([pa.array(key), *each.flatten(), pa.array(n_best), pa.array(count_sum)], names=names)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                pairs, of, plane, bits = (c[k].values for c in b.columns[1:])
                pair, place, links = postings(of, plane, bits, ~found(pairs.to_numpy())[0])
                for a in range(0, len(pair), 50_000):
                    z = a + 50_000
                    yield pa.RecordBatch.from_arrays([pa.array(pairs.to_numpy()[pair[a:z]]), pa.array((b.column(0)[k].as_py() << 12) + place[a:z]), pa.array(links[a:z])], names=["pair", "key", "links"])

    kind = chunked.schema["docs"].dataType.elementType["id"].dataType.simpleString()
    names = ["key", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    types = ["long", kind, "long", "long", "long", "long", "string", "long", "long"]
    mine = chunked.select("chunk", "docs", "pairs", "of", "plane", "bits").mapInArrow(frequent_sums, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))
    rest = chunked.select("chunk", "pairs", "of", "plane", "bits").mapInArrow(others, "pair long, key long, links long").join(scored, "pair")
    rest = rest.groupBy("key").agg(F.sum(F.col("links") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum"))
    both = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return mine.join(rest, "key", "left").select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", both("n_best", "more_best"), both("count_sum", "more_sum"), "groups_sha256")
