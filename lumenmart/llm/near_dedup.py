"""Near-duplicate detection by ProbMinHash.

A text becomes the weighted set of its shingles (five words; the weight is how often the shingle occurs). Every shingle is a
Poisson process whose rate is its weight: arrivals come after exponential waits, each falls on a random one of `registers`
registers, and a register keeps its earliest arrival. A shingle's process stops as soon as its next arrival is later than all
registers' (early termination). Two texts agree in a register with the probability of their probability Jaccard similarity
J_P = sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i), which for shingles that occur once is plain Jaccard.

The registers are shuffled in several fixed ways and each order is cut into bands of `rows` registers; texts that share a band are candidates.
The join that brings candidates together also compares their registers (a byte of each): where these agree so seldom that a J_P of the
threshold is four standard errors away, no row is made. All others are verified by their exact J_P. Texts with the same weighted
set are one node from the start, so groups of exact copies are never paired. Nor are the members of a band's bucket: in the
first rounds one member of the bucket's largest component is compared with the members outside it, another one each time. Then a growing share
of the members, up to all, are compared with the members of other components that are outside the largest one. A bucket that one component holds
by then is left alone, so only groups whose members are not linked are compared one by one. Buckets
are joined and combined by plain equi-joins and aggregations, links stay in tables, and classes are the connected components of
all verified links.

Defined results: case and punctuation don't count, words are runs of ASCII letters and digits and other non-ASCII characters;
texts of one to four words are one shingle; null, empty and wordless texts are alone in their class, each row of its own id; rows without an id
can't be linked: they are left out of `classes` and stay in `deduplicate`; rows that repeat id and text are one document, given
back as often as they came, of which `deduplicate` keeps one; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenmart.llm.common import kept, release
from lumenmart.llm.graphs import components

#: Characters of a piece of a text, and bytes that are hashed together.
PIECE, AT_ONCE = 1 << 20, 1 << 18
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


@dataclass(frozen=True)
class Settings:
    words: int = 5
    threshold: float = 0.8
    registers: int = 256
    bands: int = 64
    rows: int = 14
    first_bands: int = 6
    easy_rounds: int = 4
    shares: tuple[float, ...] = (1 / 64, 1 / 8, 1 / 2, 1.0)

    @property
    def most_different(self) -> int:
        """Registers (a byte of each) that may differ: four standard errors more than the threshold leads to expect."""
        expected = self.threshold + (1 - self.threshold) / 256
        return int((1 - expected) * self.registers + 4 * (expected * (1 - expected) * self.registers) ** 0.5)

    def places(self) -> np.ndarray:
        """The registers of each band: whole orders of all registers, one after another, cut into bands."""
        each = self.registers // self.rows
        orders = (np.random.default_rng(k).permutation(self.registers)[: each * self.rows] for k in range(-(-self.bands // each)))
        return np.concatenate(list(orders)).reshape(-1, self.rows)[: self.bands]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, with wrap-around."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for k, b in (("up", _BASE), ("down", _BACK)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word: differences of prefix sums of byte * base ** position, scaled back to position 0."""
    a = np.frombuffer(raw, np.uint8)
    if not len(a):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    up, down = _power(len(a) + 1)
    inside = np.concatenate([[False], _WORD[a], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)])])
    return mixed((sums[ends] - sums[starts]) * down[starts]), starts


def _pieces(text: str) -> Iterator[bytes]:
    """The lower-cased text, cut at spaces into pieces of bounded size."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE else max(text.rfind(" ", at, at + PIECE), at) + 1
        end = end if end > at + 1 or end == len(text) else at + PIECE
        yield text[at:end].lower().encode("utf-8", "replace")
        at = end


def weighted(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text number, shingle hash and weight, ordered by both, for a few texts."""
    hashes, owner, run, run_owner, size = [], [], [], [], 0

    def flush():
        h, first = word_hashes(b"\n".join(run))
        bounds = np.cumsum([len(x) + 1 for x in run])
        hashes.append(h)
        owner.append(np.array(run_owner)[np.searchsorted(bounds, first, side="right")])
        run.clear(), run_owner.clear()

    for k, text in enumerate(texts):
        for piece in _pieces(text or ""):
            run.append(piece)
            run_owner.append(k)
            size += len(piece)
            if size > AT_ONCE:
                flush()
                size = 0
    if run:
        flush()
    w, of = (np.concatenate(hashes), np.concatenate(owner)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))
    n = len(w) - words + 1
    if n > 0:
        sh = np.zeros(n, np.uint64)
        for j in range(words):
            sh = sh * _BASE + w[j : j + n]
        whole = of[:n] == of[words - 1 :]
        sh, sh_of = mixed(sh[whole]), of[:n][whole]
    else:
        sh, sh_of = np.empty(0, np.uint64), np.empty(0, np.int64)
    counts = np.bincount(of, minlength=len(texts)) if len(of) else np.zeros(len(texts), int)
    ends = np.cumsum(counts)
    short = [k for k in np.flatnonzero((counts > 0) & (counts < words))]
    if short:
        own = [np.uint64(xxhash.xxh64_intdigest(w[ends[k] - counts[k] : ends[k]].tobytes())) for k in short]
        sh, sh_of = np.concatenate([sh, np.array(own, np.uint64)]), np.concatenate([sh_of, np.array(short)])
    # The text's number stands above 52 bits of the hash, so one plain sort orders by both.
    key = np.sort((sh_of.astype(np.uint64) << np.uint64(52)) | (sh >> np.uint64(12)))
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    times = np.diff(np.append(at, len(key))).astype(np.int64)
    return (key[at] >> np.uint64(52)).astype(np.int64), key[at] & np.uint64((1 << 52) - 1), times


def registers(of: np.ndarray, shingles: np.ndarray, weights: np.ndarray, texts: int, m: int) -> np.ndarray:
    """The shingle in each of the m registers of each text."""
    first, held = np.full(texts * m, np.inf), np.zeros(texts * m, np.uint64)
    at, alive, r = np.zeros(len(shingles)), np.arange(len(shingles)), 0
    seed, rate = mixed(shingles ^ np.uint64(0xD1B54A32D192ED03)), weights.astype(float)
    while len(alive):
        bits = mixed(seed[alive] + np.uint64((r * 0xA0761D6478BD642F) & (2**64 - 1)))
        at[alive] -= np.log(((bits >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / rate[alive]
        latest = first.reshape(texts, m).max(axis=1)
        alive = alive[at[alive] < latest[of[alive]]]
        if not len(alive):
            break
        cell = of[alive] * m + (mixed(seed[alive] ^ np.uint64((r * 0xE7037ED1A0B428DB + 1) & (2**64 - 1))) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, cell, at[alive])
        won = at[alive] == first[cell]
        held[cell[won]] = shingles[alive[won]]
        r += 1
    return held.reshape(texts, m)


def band_keys(held: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A hash of each band's number and registers."""
    held = mixed(held)
    out = np.broadcast_to(mixed(np.arange(1, len(places) + 1, dtype=np.uint64)), (len(held), len(places))).copy()
    for j in range(places.shape[1]):
        out = out * _BASE + held[:, places[:, j]]
    return mixed(out)


def sketch(held: np.ndarray) -> np.ndarray:
    """A byte of each register, eight registers in a 64-bit number."""
    bits = (mixed(held) & np.uint64(255)).reshape(len(held), -1, 8)
    return np.bitwise_or.reduce(bits << np.arange(0, 64, 8, dtype=np.uint64), axis=2)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of bounded size together."""
    a = size = 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()):
        size += n
        if size > AT_ONCE or k - a >= 2000:
            yield a, k + 1
            a, size = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _slices(of: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(of, np.arange(n + 1))


def mark(docs: DataFrame, s: Settings) -> DataFrame:
    """docs: id, content, text. Gives id, content, node (hash of the weighted set; of the id where there is none), keys (of bands), registers (a byte of each)."""
    places = s.places()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(2)
            for a, z in _chunks(texts):
                of, sh, w = weighted(texts.slice(a, z - a).to_pylist(), s.words)
                cut = _slices(of, z - a)
                held = registers(of, sh, w, z - a, s.registers)
                keys, short = band_keys(held, places).view(np.int64), sketch(held).view(np.int64)
                nodes, lists = [], []
                for k in range(z - a):
                    i, j = cut[k], cut[k + 1]
                    nodes.append(xxhash.xxh3_128_digest(sh[i:j].tobytes() + w[i:j].tobytes() if j > i else f"none {ids[a + k]}".encode()))
                    lists.append(keys[k] if j > i else None)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, z - a), b.column(1).slice(a, z - a), pa.array(nodes, pa.binary()), pa.array(lists, pa.list_(pa.int64())), pa.array(list(short), pa.list_(pa.int64()))],
                    names=["id", "content", "node", "keys", "registers"],
                )

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, content long, node binary, keys array<long>, registers array<long>")


def sets(docs: DataFrame, s: Settings) -> DataFrame:
    """docs: node, text. Gives node, shingles, weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            for a, z in _chunks(texts):
                of, sh, w = weighted(texts.slice(a, z - a).to_pylist(), s.words)
                cut = pa.array(_slices(of, z - a).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (sh.view(np.int64), w)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), *lists], names=["node", "shingles", "weights"])

    return docs.mapInArrow(run, "node binary, shingles array<long>, weights array<long>")


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, least: float = 0.0) -> float:
    """J_P of two weighted sets (sorted shingles, weights); 0 where an upper bound of it is below least."""
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    hit = a[at] == b
    u, v = x[at[hit]], y[hit]
    if np.minimum(u / x.sum(), v / y.sum()).sum() < least:
        return 0.0
    if x.max() == 1 == y.max():
        return len(u) / (len(a) + len(b) - len(u))
    only_x = np.ones(len(a), bool)
    only_x[at[hit]] = False
    p, q = np.concatenate([u, x[only_x], np.zeros(int((~hit).sum()), np.int64)]), np.concatenate([v, np.zeros(int(only_x.sum()), np.int64), y[~hit]])
    kinds, times = np.unique((p << 32) | q, return_counts=True)
    p, q = kinds >> 32, kinds & 0xFFFFFFFF
    return sum(n / float((np.maximum(p / i, q / j) * times).sum()) for i, j, n in zip(p.tolist(), q.tolist(), times.tolist(), strict=True) if i and j)


def likely(x: Column, y: Column, s: Settings) -> Column:
    """Whether two sketches differ in few enough registers for the threshold."""
    different = F.lit(0)
    # Every other byte in 16 bits of its own: adding 255 carries to its ninth bit exactly where it is not 0.
    bytes_, carry = F.lit(0x00FF00FF00FF00FF), F.lit(0x0100010001000100)
    for k in range(s.registers // 8):
        d = F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))
        for half in (d, F.shiftrightunsigned(d, 8)):
            different += F.bit_count((half.bitwiseAND(bytes_) + bytes_).bitwiseAND(carry))
    return different <= s.most_different


def verify(pairs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) of nodes those at least that similar."""
    left = shingles.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("weights").alias("wa"))
    right = shingles.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("weights").alias("wb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.flatten().to_numpy() for c in batch.columns[2:]]
            cuts = [np.asarray(c.offsets) - c.offsets[0].as_py() for c in batch.columns[2:]]
            good = []
            for k in range(batch.num_rows):
                sa, wa, sb, wb = (x[c[k] : c[k + 1]] for x, c in zip(cols, cuts, strict=True))
                good.append(len(sa) > 0 and len(sb) > 0 and similarity(sa.view(np.uint64), wa, sb.view(np.uint64), wb, threshold - 1e-9) >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "wa", "sb", "wb").mapInArrow(run, "a binary, b binary")


def _with_keys(at: DataFrame, sketches: DataFrame) -> DataFrame:
    """at: key, node, root of the members that a round compares; with their registers and all their keys of the round."""
    # A node has a key a band at most.
    return at.join(at.groupBy("node").agg(F.collect_set("key").alias("keys")), "node").join(sketches, "node")


def _pairs(at: DataFrame, pivots: DataFrame, apart: str, s: Settings) -> DataFrame:
    """Pairs of a bucket's pivots (key, pivot, of, pivot_keys) with the members whose sketches are near theirs; a pair that meets in several buckets is made in that of
    the least key only."""
    first = F.col("key") == F.array_min(F.array_intersect("keys", "pivot_keys"))
    near = (F.col("key") == F.col("pivot_key")) & F.expr(apart) & likely(F.col("registers"), F.col("of"), s) & first
    return at.join(pivots.withColumnRenamed("key", "pivot_key"), near).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def _easy_round(members: DataFrame, sketches: DataFrame, s: Settings, k: int) -> tuple[tuple[DataFrame, ...], DataFrame]:
    """What the round keeps, and pairs of one member of each bucket's largest component with the members outside. members: key, node, root."""
    each = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node")).alias("p"))
    largest = each.groupBy("key").agg(F.max(F.struct("n", "root", "p")).alias("x"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    pivots = kept(largest.select("key", F.col("x.root").alias("most"), F.col("x.p.node").alias("pivot")), "pivots")
    # Of open buckets only the members outside are read on: the others of the largest component meet nobody.
    at = kept(_with_keys(members.join(pivots, (members["key"] == pivots["key"]) & (members["root"] != pivots["most"]), "left_semi"), sketches), "bucket-members")
    drawn_for = pivots.groupBy("pivot").agg(F.collect_set("key").alias("pivot_keys"))  # the buckets that drew it
    of = sketches.select(F.col("node").alias("pivot"), F.col("registers").alias("of"))
    return (at, pivots), _pairs(at, pivots.join(drawn_for, "pivot").join(of, "pivot"), "root <> most", s)


def _opened(members: DataFrame, sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the buckets that hold several components the members: key, node, inside (of the bucket's largest component); and of each of these nodes its keys here and registers."""
    each = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = each.groupBy("key").agg(F.max(F.struct("n", "root")).alias("x"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    open_ = kept(members.join(largest, "key").select("key", "node", (F.col("root") == F.col("x.root")).alias("inside")), "open-members")
    return open_, kept(open_.groupBy("node").agg(F.collect_set("key").alias("keys")).join(sketches, "node"), "open-nodes")


def _full_round(members: DataFrame, sketches: DataFrame, s: Settings, low: float, high: float, opened: tuple[DataFrame, DataFrame] | None = None) -> tuple[tuple[DataFrame, ...], DataFrame]:
    """What the round keeps, and pairs of the members whose draw lies from low to high with members of other components that were outside their bucket's largest component
    when the full rounds began. opened: what `_opened` gave then, with members: node, root as they stand; else it is worked out of members.

    Of two members of different components one at least was outside then. A pair of one inside comes in the round of its draw, a pair of two outside in that of the lesser
    draw. A node's draw is one number for all its buckets, so a pair comes once; over rounds from 0 to 1 every pair of a bucket is met once, and who is inside is read once."""
    roots = members if opened else members.select("node", "root").distinct()
    open_, nodes = opened or _opened(members, sketches)
    lo, hi = int(low * (1 << 20)), int(high * (1 << 20))
    drawn = f"draw >= {lo} AND draw < {hi}"
    at = open_.withColumn("draw", F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 20))).filter(f"NOT inside OR {drawn}")
    at = kept(at.join(roots, "node").join(nodes, "node"), "bucket-members")
    pivots = at.filter(drawn).select("key", F.col("node").alias("pivot"), F.col("root").alias("pivot_root"), F.col("inside").alias("pivot_inside"), F.col("registers").alias("of"), F.col("keys").alias("pivot_keys"))
    # Two pivots meet as one pair.
    once = f"(pivot_inside OR draw >= {lo} AND (node < pivot OR draw >= {hi}))"
    return (at,), _pairs(at.filter("NOT inside"), pivots, f"root <> pivot_root AND {once}", s)


def _roots(banded: DataFrame, sketches: DataFrame, shingles: DataFrame, s: Settings) -> DataFrame:
    """node, root of nodes that share a band. banded: key, band, node, of buckets with two nodes at least. A round's tables go when it ends."""
    n = sketches.count()
    roots = kept(banded.select("node").distinct().select("node", F.col("node").alias("root")), "roots", n)
    opened = None
    for k in range(s.easy_rounds + len(s.shares)):
        if k < s.easy_rounds:
            members = (banded.filter(F.col("band") < s.first_bands) if k == 0 else banded).select("key", "node").join(roots, "node")
            read, pairs = _easy_round(members, sketches, s, k)
        else:
            opened = opened or _opened(banded.select("key", "node").join(roots, "node"), sketches)
            read, pairs = _full_round(roots, sketches, s, *((0.0, *s.shares)[k - s.easy_rounds :][:2]), opened)
        links = kept(verify(pairs, shingles, s.threshold), "links")
        release(*read)
        if found := links.count():
            of = roots.withColumnRenamed("root", "r")
            edges = links.join(of.select(F.col("node").alias("a"), F.col("r").alias("ra")), "a").join(of.select(F.col("node").alias("b"), F.col("r").alias("rb")), "b")
            named = components(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b")), found)
            new = named.select(F.col("node").alias("old"), F.col("root").alias("new"))
            old, roots = roots, kept(roots.join(new, roots["root"] == new["old"], "left").select("node", F.coalesce("new", "root").alias("root")), "roots", n)
            release(old, named)
        release(links)
    release(*(opened or ()))
    return roots


def _classes(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """id, content, class_id, class_size: one row for each row with an id."""
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("content"), docs[text_col].alias("text")).filter("id IS NOT NULL")
    marked = kept(mark(rows, s), "marked")
    nodes = kept(marked.groupBy("node").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.min_by("content", "id").alias("content"), F.min_by("keys", "id").alias("keys"), F.min_by("registers", "id").alias("registers")), "nodes")
    exploded = nodes.filter("keys IS NOT NULL").select("node", F.posexplode("keys").alias("band", "key"))
    shared = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    banded = kept(exploded.join(shared, "key", "left_semi"), "banded")
    wanted = banded.select("node").distinct().join(nodes.select("node", "first_id", "content"), "node")
    texts = rows.join(wanted, (rows["id"] == wanted["first_id"]) & (rows["content"] == wanted["content"])).select("node", "text")
    shingles = kept(sets(texts, s).dropDuplicates(["node"]), "sets")
    sketches = kept(nodes.join(banded.select("node").distinct(), "node", "left_semi").select("node", "registers"), "sketches")
    roots = _roots(banded, sketches, shingles, s)
    placed = nodes.select("node", "first_id", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = placed.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_size"))
    of_node = placed.join(groups, "root").select("node", "class_id", "class_size")
    out = kept(marked.select("id", "content", "node").join(of_node, "node").select("id", "content", "class_id", "class_size"), "classes")
    release(marked, nodes, banded, shingles, sketches, roots)
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """doc_id, class_id (smallest id of its class), class_size: one row for each row of docs with an id."""
    return _classes(docs, id_col, text_col, settings or Settings()).select(F.col("id").alias("doc_id"), "class_id", "class_size")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """The rows that stay, one of each class, with all columns of docs."""
    stay = _classes(docs, id_col, text_col, settings or Settings()).filter("id = class_id").select("id", "content").distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("content"))
    found = rows.join(stay, ["id", "content"]).dropDuplicates(["id", "content"])
    return found.select("row.*").unionByName(docs.filter(docs[id_col].isNull()))
