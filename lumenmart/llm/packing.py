"""Packing token ids into sequences of at most `window` tokens by non-negative least squares.

1. One pass over the texts encodes them, adds the end id, and cuts each document into whole windows and a rest. A row a piece is kept, without its
   ids: place in the document, length, checksum (also of its first half window and of what follows, should it be cut there), and which piece of its
   length it is within its task.
2. The lengths' histogram has at most `window` rows, whatever the corpus. From it `plan` works out which lengths share a sequence: it enumerates the
   combinations of up to `depth` lengths that fill a window exactly, solves min |A x - h|, x >= 0 for how often each comes (coordinate descent, always the
   coordinate that gains most), rounds, takes back what the histogram can't give, and packs what is left greedily: rests of over half a window are cut there, then
   the longest goes first, with the longest that still fit beside it. Its result is a table of runs: the pieces of one length from the a-th to the b-th are the
   k-th members of the sequences from s on.
3. Each piece's number among all of its length follows from how many of it the tasks before had (a join by task and length), and finds its run.

Only the histogram and the runs (some thousands of rows) pass through the driver; no length, however frequent, is gathered anywhere.

Sequences are numbered from 0 without gaps. Those shorter than the window are padded to it, except at a power of two, where a shorter buffer holds them
without padding.

Defined results: a null text is empty and has the end id alone; null and repeated ids are packed like others, each row for itself; ties (pieces of equal
length) go by task and place in it; an empty table gives an empty result; extra columns are ignored; very long texts are cut into windows as they are encoded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumenmart.llm.chunks import SpacedIds, Spaced, chunks, expanded, places
from lumenmart.llm.common import kept

#: Bytes of text that a task works on at a time.
CHUNK = 4 << 20


@lru_cache(maxsize=2)
def encoder(path: str) -> SpacedIds:
    """One for all tasks of a worker."""
    return SpacedIds(path)


def encode(texts: pa.Array, own: SpacedIds, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each with the end id behind it, and where each text's begin and end among them."""
    cut = Spaced(texts)
    n, codes, known = len(texts), cut.codes.copy(), len(cut.words)
    words = texts.to_pylist() if cut.odd.any() else []
    first = own.raw([words[k] if odd else cut.words[c] for k, (odd, c) in enumerate(zip(cut.odd.tolist(), codes[cut.first].tolist(), strict=True))])
    # Codes beyond the words': the first word of each text (or all of an odd one), nothing, and the end id.
    nothing, end = known + n, known + n + 1
    codes[np.repeat(cut.odd, np.diff(cut.ends))] = nothing
    codes[cut.first] = known + np.arange(n)
    codes = np.insert(codes, cut.ends[1:], end)
    table = [*own.of(cut.plain), *first, b"", np.array([end_id], own.kind).tobytes()]
    at = places([len(x) // own.kind.itemsize for x in table])
    flat = np.frombuffer(b"".join(table), own.kind)[expanded(codes, at)]
    return flat, places(np.diff(at)[codes])[places(np.diff(cut.ends) + 1)]


def pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int, window: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, part, nth (of its length within the part), head_crc, tail_crc (of the two parts that half a window cuts) of each piece."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = rows.schema["doc_id"].dataType
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth", "head_crc", "tail_crc"]
    schema = pa.schema([(n, to_arrow_type(kind) if n == "doc_id" else pa.int32() if n in ("length", "part") else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part, met = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for ids, texts in chunks(batches, CHUNK):
            flat, ends = encode(texts, own, end_id)
            sizes = np.diff(ends)
            many = -(-sizes // window)
            of = np.repeat(np.arange(len(sizes)), many)
            start = (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * window
            length = np.minimum(window, sizes[of] - start)
            begin = ends[of] + start
            raw = memoryview(flat.astype("<u4").tobytes())
            crc = lambda a, z: pa.array([zlib.crc32(raw[i:j]) for i, j in zip((4 * a).tolist(), (4 * z).tolist(), strict=True)], pa.int64())  # noqa: E731, B023
            half = begin + np.where(length < window, np.minimum(length, window // 2), 0)  # whole windows stay whole
            order = np.argsort(length, kind="stable")
            counts = np.bincount(length, minlength=window + 1)
            nth = np.empty(len(of), np.int64)
            nth[order] = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
            nth += met[length]
            met += counts
            cols = [ids.take(pa.array(of)), pa.array(start), pa.array(length.astype(np.int32)), crc(begin, begin + length), pa.array(sizes[of]), pa.array(np.full(len(of), part, np.int32)), pa.array(nth)]
            cols += [crc(begin, half), crc(half, np.where(half > begin, begin + length, half))]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, start long, length int, ids_crc32 long, doc_tokens long, part int, nth long, head_crc long, tail_crc long")


def combinations(lengths: np.ndarray, window: int, depth: int = 3) -> np.ndarray:
    """Rows of up to 3 of the given lengths, ascending, that fill the window; shorter ones begin with 0."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    out = [np.array([[0, 0, window]])] if there[window] else []
    if depth > 1:
        a = np.arange(1, window // 2 + 1)
        a = a[there[a] & there[window - a]]
        out.append(np.stack([np.zeros_like(a), a, window - a], 1))
    if depth > 2:
        a, b = (x.ravel() for x in np.meshgrid(lengths, lengths, indexing="ij"))
        c = window - a - b
        fits = (a <= b) & (b <= c)
        a, b, c = a[fits], b[fits], c[fits]
        fits = there[c]
        out.append(np.stack([a[fits], b[fits], c[fits]], 1))
    return np.concatenate(out) if out else np.empty((0, 3), np.int64)


def solve(combos: np.ndarray, counts: np.ndarray, steps: int = 20_000) -> np.ndarray:
    """x >= 0 with sum over combos of x times the members of each length near counts, by coordinate descent; counts[0] is not looked at.

    Ends where no step would change a repeat count by half a sequence or a thousandth of the mean."""
    x, rest = np.zeros(len(combos)), counts.astype(float)
    rest[0] = 0
    members = [(combos == v[:, None]) & (v[:, None] > 0) for v in combos.T]
    norm = sum(m.sum(1) for m in members).astype(float)  # a length that comes twice counts 4
    least = max(0.5, 1e-3 * counts[1:].sum() / max(1, np.count_nonzero(counts[1:])))
    a, b, c = combos.T
    for _ in range(steps if len(combos) else 0):
        step = np.maximum((rest[a] + rest[b] + rest[c]) / norm, -x)
        k = int(np.argmax(np.abs(step) * np.sqrt(norm)))
        if abs(step[k]) < least:
            break
        x[k] += step[k]
        np.subtract.at(rest, combos[k][combos[k] > 0], step[k])
    return x


def plan(counts: np.ndarray, window: int, depth: int = 3) -> tuple[np.ndarray, np.ndarray, int]:
    """counts[l]: pieces of length l. Runs (length, first, sequence, offset, many); whole[l], how many of a length stay whole; the number of sequences.

    Pieces of length l beyond whole[l] are cut at half a window; the parts are numbered behind the pieces of their own length, by ascending l."""
    left, runs, used, sequence = counts.astype(np.int64).copy(), [], np.zeros(window + 1, np.int64), 0

    def take(members: list[int], times: int) -> None:
        nonlocal sequence
        at = 0
        for length in members:
            runs.append((length, used[length], sequence, at, times))
            used[length] += times
            left[length] -= times
            at += length
        sequence += times

    def possible(members: list[int]) -> int:
        return min(int(left[m]) // members.count(m) for m in members)

    combos = combinations(np.flatnonzero(left[1:]) + 1, window, depth)
    repeats = np.rint(solve(combos, left)).astype(np.int64)
    for k in np.argsort(-repeats, kind="stable")[: np.count_nonzero(repeats)]:
        members = combos[k][combos[k] > 0].tolist()
        if times := min(int(repeats[k]), possible(members)):
            take(members, times)
    if left[window]:
        take([window], int(left[window]))
    half, whole = window // 2, counts.astype(np.int64).copy()
    for length in range(half + 1, window):
        whole[length] = used[length]
        left[half] += left[length]
        left[length - half] += left[length]
        left[length] = 0
    for longest in range(half, 0, -1):
        while left[longest]:
            members, room, free = [longest], window - longest, left.copy()
            free[longest] -= 1
            while room and (fits := np.flatnonzero(free[1 : room + 1])).size:
                m = int(fits[-1]) + 1
                many = min(room // m, int(free[m]))
                members += [m] * many
                free[m] -= many
                room -= many * m
            take(members, possible(members))
    return np.array(runs, np.int64).reshape(-1, 5), whole, sequence


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, window: int = 1024, depth: int = 3) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = kept(pieces(docs, tokenizer, id_col, text_col, end_id, window), "pieces")
    sizes = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("many"))
    counts, half = np.zeros(window + 1, np.int64), window // 2
    for r in sizes.groupBy("length").agg(F.sum("many").alias("many")).collect():  # at most as many rows as the window has tokens
        counts[r.length] = r.many
    runs, whole, _ = plan(counts, window, depth)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    cuts = counts - whole
    # Numbers of the first parts: heads behind the pieces of half a window, tails behind those of their own length.
    heads = counts[half] + np.cumsum(cuts) - cuts
    before = sizes.select("part", "length", (F.sum("many").over(Window.partitionBy("length").orderBy("part")) - F.col("many")).alias("before"))
    numbered = cut.join(before, ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("nth"), "head_crc", "tail_crc")
    # Runs of a length begin at numbers that ascend: one sorted key finds the run of each piece.
    wide = int(runs[:, 1].max(initial=0) + runs[:, 4].max(initial=0)) + 1
    keys = runs[:, 0] * wide + runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, length, crc, nth, head, tail = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3, 5, 6, 7))
            two = nth >= whole[length]
            of = np.repeat(np.arange(b.num_rows), 1 + two)
            second = np.append(False, of[1:] == of[:-1]) if len(of) else np.empty(0, bool)
            first = two[of] & ~second
            rank = nth[of] - whole[length[of]]
            number = np.where(first, heads[length[of]] + rank, np.where(second, counts[np.maximum(length[of] - half, 0)] + rank, nth[of]))
            own = np.where(first, half, np.where(second, length[of] - half, length[of]))
            k = np.searchsorted(keys, own * wide + number, side="right") - 1
            cols = [b.column(0).take(pa.array(of)), pa.array(start[of] + half * second), pa.array(own), pa.array(np.where(first, head[of], np.where(second, tail[of], crc[of])))]
            cols += [b.column(4).take(pa.array(of)), pa.array(runs[k, 2] + number - runs[k, 1]), pa.array(runs[k, 3])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = numbered.schema["doc_id"].dataType.simpleString()
    return numbered.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
