"""Benchmark decontamination by latent semantic retrieval.

Terms are the words of the benchmark. One pass over the whole texts keeps, for each document, the positions of terms; what
follows reads these positions only. Passages are windows of 32 words; those that don't overlap make up the TF-IDF matrix A (document
frequencies over all passages; terms in more than `common` of the passages carry no weight, but for the `weighted` rarest of each
item) is factored by a randomised SVD: a random test matrix, its product with A^T A, a distributed pass whose partial sums Spark
adds up term by term, and a small decomposition on the driver; its size is terms x rank, whatever the corpus. Items and
passages, now in steps of 16 words, meet in the latent space: an item is a candidate of a passage at a cosine of at least `cosine`. A candidate counts as
contamination where the longest common subsequence of words covers `verbatim` of the item, or `paraphrase` of it while
`answer` of the item's telling words (its rarest) are there too.

No cosine follows from that rule, so what the latent space does not bring up is searched exactly: an accepted passage lacks at most a
fixed number of the item's words, hence holds enough of its rarest ones (`_rest`). All pairs of item and document are found that the
rule takes for any passage; a pair that both ways find is answered by the passage that the latent space gave.

The subsequence is exact: words outside the benchmark can't be part of one, so positions of terms are all that it needs.
Nothing of a document's is collected; a document's passages are compared where it lies.

Defined results: items may be of any length, longer ones than a window are held against as much of the text, those of fewer than three different words are found
where they stand word for word; case and punctuation don't count, words are runs of ASCII letters and digits and other non-ASCII characters; null and empty texts and items have no passages; equal items are found each under its
own id; rows that repeat are answered as often as they come; null ids are answered with a null id; with an empty table or benchmark nothing is found;
extra columns are ignored (`contaminated`) or stay as they are (`clean`).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenmart.llm.common import kept
from lumenmart.llm.near_dedup import AT_ONCE, _pieces, word_hashes


@dataclass(frozen=True)
class Settings:
    """rank, oversampling: of the SVD; max_terms bounds the terms that carry weight besides those `weighted` of each item (the rarest stay); least: different words, fewer make an item short."""

    block: int = 16
    blocks: int = 2
    common: float = 0.005
    telling: int = 5
    weighted: int = 10
    least: int = 3
    rank: int = 128
    oversampling: int = 16
    max_terms: int = 50_000
    cosine: float = 0.4
    full_cosine: float = 0.3
    verbatim: float = 0.8
    paraphrase: float = 0.6
    answer: float = 0.8
    seed: int = 7


@dataclass
class Benchmark:
    """Items as term numbers; terms: the sorted hashes of their words."""

    ids: list
    items: list[np.ndarray]
    terms: np.ndarray


def words_of(text: str | None) -> np.ndarray:
    """The words' hashes, in order."""
    parts = [word_hashes(piece)[0] for piece in _pieces(text or "")]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def read_benchmark(benchmark: DataFrame, id_col: str, text_col: str) -> Benchmark:
    """The benchmark is small beside any corpus and is read by the driver."""
    rows = [(r[0], words_of(r[1])) for r in benchmark.select(benchmark[id_col], benchmark[text_col]).collect()]
    rows = [(i, w) for i, w in rows if len(w)]
    terms = np.unique(np.concatenate([w for _, w in rows])) if rows else np.empty(0, np.uint64)
    return Benchmark([i for i, _ in rows], [np.searchsorted(terms, w).astype(np.int32) for _, w in rows], terms)


def term_hits(texts: list[str | None], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text number, word position and term of each term in some texts."""
    out, waiting, owner, size, seen = [], [], [], 0, np.zeros(len(texts), np.int64)

    def flush():
        h, first = word_hashes(b"\n".join(waiting))
        of = np.array(owner)[np.searchsorted(np.cumsum([len(x) + 1 for x in waiting]), first, side="right")]
        begin = np.searchsorted(of, np.arange(len(texts) + 1))
        at = np.arange(len(h)) - begin[of] + seen[of]
        seen[:] += np.diff(begin)
        t = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
        hit = terms[t] == h
        out.append((of[hit], at[hit], t[hit]))
        waiting.clear(), owner.clear()

    for k, text in enumerate(texts):
        for piece in _pieces(text or ""):
            waiting.append(piece), owner.append(k)
            size += len(piece)
            if size > AT_ONCE:
                flush()
                size = 0
    if waiting:
        flush()
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def positions(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """docs: id, content, text. Gives id, content, at and term (lists) for the documents with terms."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            of, at, term = term_hits(part.column(2).to_pylist(), sent.value)
            rows, begin = np.unique(of, return_index=True)
            cut = pa.array(np.append(begin, len(of)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (at, term)]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int32())) for c in part.columns[:2]), *lists], names=["id", "content", "at", "term"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, content long, at array<int>, term array<int>")


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what is made of them stays small."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def _flat(b: pa.RecordBatch, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, block and term of each hit; blocks number through the batch, with room for windows between documents."""
    at, term = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
    offsets = np.asarray(at.offsets) - at.offsets[0].as_py()
    at, term = at.flatten().to_numpy(), term.flatten().to_numpy()
    row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
    block = at // s.block
    last = np.zeros(b.num_rows, np.int64)
    full = np.flatnonzero(np.diff(offsets))
    last[full] = block[offsets[1:][full] - 1]
    base = np.concatenate([[0], np.cumsum(last + s.blocks)])[:-1] + s.blocks - 1
    return row, block + base[row], term


def _windows(block: np.ndarray, term: np.ndarray, s: Settings, apart: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """window, term, count: window w covers blocks w to w + blocks - 1. apart: only windows that don't overlap."""
    n = int(term.max()) + 1 if len(term) else 1
    block = block.astype(np.int64)
    keys = block // s.blocks * s.blocks * n + term if apart else np.concatenate([(block - j) * n + term for j in range(s.blocks)])
    keys, times = np.unique(keys, return_counts=True)
    return keys // n, keys % n, times


def document_frequencies(hits: DataFrame, s: Settings) -> tuple[dict[int, int], int]:
    """In how many passages each term occurs, and the number of passages that have terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, passages = Counter(), 0
        for b in _parts(batches):
            _, block, term = _flat(b, s)
            window, t, _ = _windows(block, term, s, apart=True)
            passages += len(np.unique(window))
            ids, n = np.unique(t, return_counts=True)
            counted.update(dict(zip(ids.tolist(), n.tolist(), strict=True)))
        rows = [*counted.items(), (-1, passages)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())], names=["term", "n"])

    got = hits.select("at", "term").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r.term: r.n for r in got.collect()}  # one row a term of the benchmark
    return found, found.pop(-1, 0)


def _product(hits: DataFrame, weight: np.ndarray, q: np.ndarray, s: Settings) -> np.ndarray:
    """A^T (A q) over all passages, rows of A scaled to length 1."""
    sent = hits.sparkSession.sparkContext.broadcast((weight.astype(np.float32), q.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, q = sent.value
        total, used = np.zeros(q.shape, np.float32), np.zeros(len(q), bool)
        for b in _parts(batches):
            for window, t, v in _rows(b, weight, s, apart=True):
                y = np.add.reduceat(q[t] * v[:, None], np.flatnonzero(np.r_[True, window[1:] != window[:-1]]), axis=0)
                of = np.cumsum(np.r_[0, window[1:] != window[:-1]])
                order = np.argsort(t, kind="stable")
                ts = t[order]
                starts = np.flatnonzero(np.r_[True, ts[1:] != ts[:-1]])
                total[ts[starts]] += np.add.reduceat(y[of[order]] * v[order, None], starts, axis=0)
                used[ts[starts]] = True
        t = np.flatnonzero(used).astype(np.int32)
        cut = pa.array(np.arange(len(t) + 1, dtype=np.int32) * q.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.ListArray.from_arrays(cut, pa.array(total[t].ravel()))], names=["term", "v"])

    def add(parts: pa.Table) -> pa.Table:
        x = np.stack([c.values.to_numpy() for c in parts.column("v")]).sum(axis=0, dtype=np.float64).astype(np.float32)
        return pa.table({"term": parts.column("term").slice(0, 1), "v": pa.array([x], pa.list_(pa.float32()))})

    # Sums of a task, then of a term: a group has one row a task at most.
    sums = hits.select("at", "term").mapInArrow(run, "term int, v array<float>").groupBy("term").applyInArrow(add, "term int, v array<float>").toArrow()
    out = np.zeros(q.shape)
    for t, v in zip(sums.column("term").to_pylist(), sums.column("v"), strict=True):
        out[t] = v.values.to_numpy()
    return out


def _rows(b: pa.RecordBatch, weight: np.ndarray, s: Settings, apart: bool, at_once: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """window, term, value of unit-length TF-IDF rows with at least s.least different weighted terms, some whole windows at a time."""
    _, block, term = _flat(b, s)
    heavy = weight[term] > 0
    window, t, n = _windows(block[heavy], term[heavy], s, apart)
    if not len(window):
        return
    first = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
    size = np.diff(np.r_[first, len(window)])
    v = weight[t] * (1 + np.log(n, dtype=np.float32))
    length = np.sqrt(np.add.reduceat(v * v, first))
    keep = np.repeat(size >= s.least, size)
    window, t, v = window[keep], t[keep], (v / np.repeat(length, size))[keep]
    a = 0
    while a < len(window):
        z = min(a + at_once, len(window))
        while z < len(window) and window[z] == window[z - 1]:
            z += 1
        yield window[a:z], t[a:z], v[a:z]
        a = z


@dataclass
class Rare:
    """The rarest words of each item, item by item: item, term, times in the item, whether telling. first, order: postings by term.

    all, told: how many of an item's rarest words there are, with repetitions, and how many telling ones."""

    item: np.ndarray
    term: np.ndarray
    times: np.ndarray
    tells: np.ndarray
    first: np.ndarray
    order: np.ndarray
    all: np.ndarray
    told: np.ndarray
    length: np.ndarray
    short: np.ndarray

    def enough(self, j: np.ndarray | int, present: np.ndarray, told: np.ndarray, s: Settings) -> np.ndarray:
        """Whether so many of item j's rarest words allow its acceptance; false only where the rule can't hold."""
        lacks = self.all[j] - present - 1e-6
        n = self.length[j]
        return (lacks <= (1 - s.verbatim) * n) | ((told >= s.answer * self.told[j] - 1e-6) & (lacks <= (1 - s.paraphrase) * n))


def rarest_words(bench: Benchmark, idf: np.ndarray, s: Settings) -> Rare:
    """Of each item its rarest words, more than an accepted passage can lack, and all telling ones."""
    rows = []
    for j, item in enumerate(bench.items):
        t, c = np.unique(item, return_counts=True)
        by = np.lexsort((t, -idf[t]))
        m = min(len(t), max(s.telling, int(np.searchsorted(np.cumsum(c[by]), (1 - s.paraphrase) * len(item) + 1e-6, side="right")) + 1))
        rows.append((np.full(m, j), t[by[:m]], c[by[:m]], np.arange(m) < s.telling))
    item, term, times, tells = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.argsort(term, kind="stable")
    count = len(bench.items)
    short = np.array([len(set(i.tolist())) < s.least for i in bench.items])
    return Rare(
        item, term, times, tells, np.searchsorted(term[order], np.arange(len(bench.terms) + 1)), order, np.bincount(item, times, count), np.bincount(item, tells, count), np.array([len(i) for i in bench.items]), short
    )


@dataclass
class Space:
    weight: np.ndarray
    basis: np.ndarray
    items: np.ndarray
    keys: np.ndarray
    values: np.ndarray
    telling: list[np.ndarray]
    rare: Rare

    def value(self, item: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Entries of the items' unit-length rows, which are kept sparse: keys are item * terms + term."""
        wanted = item * len(self.weight) + term
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], 0)

    def membership(self, bench: Benchmark) -> dict[int, np.ndarray]:
        """Whether each term is in an item; made for the items that come up."""

        class Made(dict):
            def __missing__(made, j):
                made[j] = np.isin(np.arange(len(self.weight)), bench.items[j])
                return made[j]

        return Made()


def fit(hits: DataFrame, bench: Benchmark, s: Settings) -> Space:
    df, passages = document_frequencies(hits, s)
    n = np.array([df.get(k, 0) for k in range(len(bench.terms))], float)
    idf = np.log((passages + 1) / (n + 1)) + 1e-3
    weight, telling, held = np.where(n <= s.common * max(1, passages), idf, 0.0), [], np.zeros(len(n), bool)
    for item in bench.items:
        rarest = sorted(set(item.tolist()), key=lambda t: (-idf[t], t))
        telling.append(np.array(rarest[: s.telling], np.int32))
        held[rarest[: s.weighted]] = True
    if (weight > 0).sum() > s.max_terms:
        weight[weight < np.sort(weight)[-s.max_terms]] = 0
    weight[held] = idf[held]
    keys, values = [], []
    for k, item in enumerate(bench.items):
        t, c = np.unique(item, return_counts=True)
        v = weight[t] * (1 + np.log(c))
        keys.append(k * len(weight) + t.astype(np.int64))
        values.append(v / max(np.linalg.norm(v), 1e-12))
    keys, values = np.concatenate(keys), np.concatenate(values)
    of, term = keys // len(weight), keys % len(weight)

    def items_product(x: np.ndarray) -> np.ndarray:
        """The items' rows times x."""
        out = np.zeros((len(bench.items), x.shape[1]))
        np.add.at(out, of, x[term] * values[:, None])
        return out

    def items_part(x: np.ndarray) -> np.ndarray:
        out, y = np.zeros(x.shape), items_product(x)
        np.add.at(out, term, y[of] * values[:, None])
        return out

    rank = min(s.rank + s.oversampling, len(weight))
    test = np.linalg.qr(np.random.default_rng(s.seed).standard_normal((len(weight), rank)))[0]
    # The items are passages too: a benchmark that the corpus never shows still has its directions. One product gives the right
    # singular vectors by Nystroem's approximation: A^T A ~ Y (Q^T Y)^-1 Y^T with Y = A^T A Q, shifted a little to stay definite.
    y = _product(hits, weight, test, s) + items_part(test)
    shift = np.sqrt(len(weight)) * 1e-6 * max(np.linalg.norm(y), 1e-6)
    y = y + shift * test
    core = test.T @ y
    b = np.linalg.solve(np.linalg.cholesky((core + core.T) / 2 + shift * np.eye(rank)), y.T).T
    basis = np.linalg.svd(b, full_matrices=False)[0][:, : s.rank].astype(np.float32)
    items = items_product(basis)
    return Space(weight.astype(np.float32), basis, (items / np.maximum(np.linalg.norm(items, axis=1, keepdims=True), 1e-12)).astype(np.float32), keys, values.astype(np.float32), telling, rarest_words(bench, idf, s))


def lcs(item: np.ndarray, passage: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit a word of the item."""
    where: dict[int, int] = {}
    for k, t in enumerate(item.tolist()):
        where[t] = where.get(t, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for t in passage.tolist():
        m = where.get(t, 0)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(item) - row.bit_count()


def _near(row: np.ndarray, term: np.ndarray, rows: int, rare: Rare, s: Settings, cells: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """row and item of each pair where the document holds enough of the item's rarest words."""
    terms, items = len(rare.first) - 1, len(rare.length)
    pairs = np.unique(row.astype(np.int64) * terms + term)
    row, term = pairs // terms, pairs % terms
    at_once = max(1, cells // items)
    for a in range(0, rows, at_once):
        lo, hi = np.searchsorted(row, [a, a + at_once])
        size = min(at_once, rows - a) * items
        present, told = np.zeros(size), np.zeros(size)
        while lo < hi:
            # Postings of some terms at a time, so that what is made of them stays small.
            many = np.diff(rare.first)[term[lo:hi]]
            z = max(1, int(np.searchsorted(np.cumsum(many), cells, side="right")))
            many, begin = many[:z], rare.first[term[lo : lo + z]]
            p = rare.order[np.repeat(begin - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())]
            cell = np.repeat((row[lo : lo + z] - a) * items, many) + rare.item[p]
            present += np.bincount(cell, rare.times[p], size)
            told += np.bincount(cell, rare.tells[p], size)
            lo += z
        some = np.flatnonzero(present)
        some = some[rare.enough(some % items, present[some], told[some], s)]
        yield from zip((some // items + a).tolist(), (some % items).tolist(), strict=True)


def _passage(at: np.ndarray, term: np.ndarray, j: int, member: np.ndarray, bench: Benchmark, space: Space, s: Settings) -> tuple | None:
    """common share, answer share, cosine, first word of the best of all passages of one document, if the rule takes one."""
    item, rare, telling = bench.items[j], space.rare, space.telling[j]
    n, size = len(item), s.block * s.blocks
    own = member[term]
    places, words = at[own], term[own]
    begin = np.arange(int(at[-1]) // s.block + 1) * s.block
    p, q = np.searchsorted(places, begin - n), np.searchsorted(places, begin + size + n)
    far = q - p >= s.paraphrase * n
    begin, p, q = begin[far], p[far], q[far]
    present, told = np.zeros(len(begin)), np.zeros(len(begin))
    mine = slice(*np.searchsorted(rare.item, [j, j + 1]))
    for t, times, tells in zip(rare.term[mine], rare.times[mine], rare.tells[mine], strict=True):
        seen = np.r_[0, np.cumsum(words == t)]
        there = seen[q] > seen[p]
        present += times * there
        told += tells & there
    left = rare.enough(j, present, told, s)
    begin, p, q = begin[left], p[left], q[left]
    inside = np.searchsorted(places, begin + size) - np.searchsorted(places, begin)
    best = None
    by = np.argsort(-inside, kind="stable")
    # Passages with the same words of the item are one: long items stand in many.
    for k in by[np.sort(np.unique((p * (len(words) + 1) + q)[by], return_index=True)[1])].tolist():
        passage = words[p[k] : q[k]]
        share, answer = lcs(item, passage) / n, float(np.isin(telling, passage).mean())
        if (share >= s.verbatim or share >= s.paraphrase and answer >= s.answer) and (best is None or (share, answer) > best[:2]):
            best = share, answer, int(begin[k])
            if best[:2] == (1, 1):
                break
    return best and (*best[:2], _cosine(at, term, best[2], j, space, s), best[2])


def _cosine(at: np.ndarray, term: np.ndarray, begin: int, j: int, space: Space, s: Settings) -> float:
    """Latent cosine of an item and the window that begins there, 0 where one of them has no weighted terms."""
    t, c = np.unique(term[slice(*np.searchsorted(at, [begin, begin + s.block * s.blocks]))], return_counts=True)
    v = space.weight[t] * (1 + np.log(c))
    latent = space.basis[t].T @ (v / max(np.linalg.norm(v), 1e-12))
    return float(latent @ space.items[j] / max(np.linalg.norm(latent), 1e-6))


def _short(row: np.ndarray, at: np.ndarray, term: np.ndarray, first: np.ndarray, bench: Benchmark, space: Space, s: Settings) -> Iterator[tuple]:
    """Where short items stand word for word: row, item and the answer, the first place of each document."""
    order = np.argsort(term, kind="stable")
    ordered = term[order]
    for j in np.flatnonzero(space.rare.short).tolist():
        item = bench.items[j]
        i = order[slice(*np.searchsorted(ordered, [item[0], item[0] + 1]))]
        for d, t in enumerate(item[1:].tolist(), 1):
            i = i[i + d < len(term)]
            i = i[(term[i + d] == t) & (at[i + d] == at[i] + d) & (row[i + d] == row[i])]
        for k, f in zip(*np.unique(row[i], return_index=True), strict=True):
            a, z = first[k], first[k + 1]
            begin = int(at[i[f]])
            yield int(k), j, (1.0, 1.0, _cosine(at[a:z], term[a:z], begin // s.block * s.block, j, space, s), begin)


def _rest(row: np.ndarray, at: np.ndarray, term: np.ndarray, first: np.ndarray, found: set, of_item: dict, bench: Benchmark, space: Space, s: Settings) -> Iterator[tuple]:
    """What the latent space did not bring up, found exactly: row, item and what `_passage` gives."""
    for k, j in _near(row, term, len(first) - 1, space.rare, s):
        if (k, j) not in found and not space.rare.short[j]:
            a, z = first[k], first[k + 1]
            got = _passage(at[a:z], term[a:z], j, of_item[j], bench, space, s)
            if got:
                yield k, j, got


def _search(b: pa.RecordBatch, bench: Benchmark, space: Space, s: Settings) -> list[tuple]:
    """row, item, cosine, common share, answer share, first word of the best passage: of each pair of document and item that passes."""
    row, block, _ = _flat(b, s)
    at_all, term_all = b.column(b.num_columns - 2).flatten().to_numpy(), b.column(b.num_columns - 1).flatten().to_numpy()
    first_of_row = np.searchsorted(row, np.arange(b.num_rows + 1))
    of_item = space.membership(bench)
    best: dict[tuple[int, int], tuple] = {}
    for window, t, v in _rows(b, space.weight, s, apart=False):
        starts = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
        latent = np.add.reduceat(space.basis[t] * v[:, None], starts, axis=0)
        cos = latent @ space.items.T
        cos /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-6)
        near, which = np.nonzero(cos >= s.cosine)
        # The latent space has fewer dimensions than there are items: a candidate must come near in the full space too.
        sizes = np.diff(np.r_[starts, len(window)])[near]
        terms = np.repeat(starts[near] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        full = np.bincount(np.repeat(np.arange(len(near)), sizes), v[terms] * space.value(np.repeat(which, sizes), t[terms]), minlength=len(near)) if len(near) else np.empty(0)
        for i, j in zip(near[full >= s.full_cosine].tolist(), which[full >= s.full_cosine].tolist(), strict=True):
            if space.rare.short[j]:
                continue
            w, item = int(window[starts[i]]), bench.items[j]
            # The document of the window, and its terms from one item before the window to one after.
            k = int(row[min(np.searchsorted(block, w), len(row) - 1)])
            a, z = first_of_row[k], first_of_row[k + 1]
            begin = int(at_all[a + np.searchsorted(block[a:z], w)]) // s.block * s.block
            lo, hi = begin - len(item), begin + s.block * s.blocks + len(item)
            p, q = a + np.searchsorted(at_all[a:z], [lo, hi])
            passage = term_all[p:q]
            # As many of the passage's words at most can be common.
            if of_item[j][passage].sum() < s.paraphrase * len(item):
                continue
            share = lcs(item, passage) / len(item)
            if share >= s.paraphrase:
                answer = float(np.isin(space.telling[j], passage).mean())
                if share >= s.verbatim or answer >= s.answer:
                    found = (share, answer, float(cos[i, j]), -begin)
                    best[k, int(j)] = max(found, best.get((k, int(j)), found))
    for k, j, (share, answer, cosine, begin) in list(_rest(row, at_all, term_all, first_of_row, set(best), of_item, bench, space, s)):
        best[k, j] = share, answer, cosine, -begin
    for k, j, (share, answer, cosine, begin) in _short(row, at_all, term_all, first_of_row, bench, space, s):
        best[k, j] = share, answer, cosine, -begin
    return [(k, j, c, x, y, -m) for (k, j), (x, y, c, m) in sorted(best.items())]


def _contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, s: Settings) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("content"), docs[text_col].alias("text"))
    bench = read_benchmark(benchmark, item_id, item_text)
    id_type, item_type = rows.schema["id"].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"id {id_type}, content long, item_id {item_type}, cosine double, common double, answer double, word int"
    if not bench.items:
        return spark.createDataFrame([], schema)
    hits = kept(positions(rows, bench.terms), "positions")
    sent = spark.sparkContext.broadcast((bench, fit(hits, bench, s)))
    item_arrow = pa.int64() if item_type in ("bigint", "long") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench, space = sent.value
        for b in _parts(batches):
            got = _search(b, bench, space, s)
            k, j, *rest = zip(*got, strict=True) if got else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(k, pa.int32())) for c in b.columns[:2]), pa.array([bench.ids[x] for x in j], item_arrow), *(pa.array(x, pa.float64()) for x in rest[:3]), pa.array(rest[3], pa.int32())],
                names=["id", "content", "item_id", "cosine", "common", "answer", "word"],
            )

    return hits.mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", settings: Settings | None = None) -> DataFrame:
    """doc_id, item_id, cosine, common (share of the item in the longest common subsequence), answer, word (where it starts): one row for each pair found."""
    return _contaminated(docs, benchmark, id_col, text_col, item_id, item_text, settings or Settings()).withColumnRenamed("id", "doc_id").drop("content")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", settings: Settings | None = None) -> DataFrame:
    """The rows of docs in which nothing was found, with all their columns."""
    found = kept(_contaminated(docs, benchmark, id_col, text_col, item_id, item_text, settings or Settings()).select("id", "content").distinct(), "contaminated")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("content"))
    same = rows["id"].eqNullSafe(found["id"]) & (rows["content"] == found["content"])
    return rows.join(found, same, "left_anti").select("row.*")
