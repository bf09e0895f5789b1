"""SentencePiece encoding and decoding over a relational lattice.

The text is cut into units that no piece of the model spans (a space opens a unit; within it, two characters part where no piece
holds them side by side). Encoding is worked out once for each different unit of the corpus:

1. one pass over the texts gives a row for each chunk of them: its different units, and for each text the numbers of its units;
2. units are grouped, each with the chunks that hold it; every substring, up to the length of the longest piece that begins with the same four characters (an equi-join to a table
   of these), is exploded and equi-joined to the piece table (both of fixed size, broadcast). Units longer than `block` are exploded in blocks that overlap, and go by a digest of their text from there on;
3. the matches are the edges of the unit's lattice and are grouped by unit;
4. a higher-order `aggregate` folds the lattice from left to right, Viterbi's way: for each prefix it keeps the best edge to end with,
   by the sum of scores of the prefix that the edge starts from, of the edge, and of their meeting. Another walks back along these edges.

A unigram model's edges always may meet. The model here is a BPE model, for which the best sum of its scores alone is not what its merges give:
two of its pieces may meet only if merging never joins across their border, which is so exactly when the pair encodes to itself.
Where they may not, the meeting costs more than any sum of scores. A prefix has exactly one chain of pieces without such a cost, its BPE
segmentation. Whether two may meet follows from the order in which they were merged (`Merges.compatible`).

Chunks then take their units' ids: the most frequent units come as a broadcast table of bounded size, others are sent to each chunk that holds
them, under their number there, and neither texts nor codes are shuffled. Decoding maps ids to pieces, joins bytes, and turns the marks back into spaces.

Defined results: null texts are empty and have no ids; a character without a piece becomes its bytes; all white space but the space
is a character like others; the mark U+2581 in a text reads as a space, as the model has it; null ids are passed on and rows that repeat
are encoded alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumenmart.llm.common import kept, kept_by

SPACE = "▁"
#: Characters of a unit that goes by itself, and of a substring that bounds the pieces which begin with it.
NAME, HEAD = 64, 4
#: Characters of texts that are cut into units at once, and different units from which a chunk is full.
PART, UNITS = 1 << 21, 400_000
#: A token takes three bytes on its way to its chunk; from here on it is a code point, of a character without a piece.
OTHER = 1 << 23
PAIR_BITS = 22


@dataclass(frozen=True)
class Settings:
    """frequent: units in the broadcast table; block: positions that the fold holds in one array; chunk: characters of texts in one row, about."""

    frequent: int = 120_000
    block: int = 256
    chunk: int = 1 << 24


@lru_cache(maxsize=2)
def _load(path: str) -> Merges:
    return Merges(path)


class Merges:
    """A BPE model's pieces, and which two may stand side by side."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.ids = {model.id_to_piece(i): i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        self.rank = {i: -model.get_score(i) for i in self.ids.values()}
        self.pieces = {i: p for p, i in self.ids.items()}
        self.raw = {i: bytes([b]) for b, i in self.bytes.items()} | {i: p.replace(SPACE, " ").encode() for i, p in self.pieces.items()}
        self.longest = max(map(len, self.ids))
        each = [self.raw.get(i, b"") for i in range(n)]
        self.flat, self.places = np.frombuffer(b"".join(each), np.uint8), np.append(0, np.cumsum([len(x) for x in each])).astype(np.int64)
        self.scores = np.array([model.get_score(i) for i in range(n)])
        self.joined = {ab for p in self.ids for ab in zip(p, p[1:], strict=False)}
        spaced = lambda c: ord(c.replace(SPACE, " "))
        pairs = np.array([(spaced(a), spaced(b)) for a, b in self.joined if b != SPACE or a == SPACE], np.int64).reshape(-1, 2)
        ascii_ = pairs.max(axis=1, initial=0) < 128
        self.apart = np.ones((128, 128), bool)
        self.apart[pairs[ascii_, 0], pairs[ascii_, 1]] = False
        self.together = np.sort(pairs[~ascii_, 0] << 32 | pairs[~ascii_, 1])
        self.spines: dict[int, tuple[list, list]] = {}
        self.pair_keys = self.pair_fits = None

    def units(self, word: str) -> list[str]:
        """word, cut where no piece holds two neighbouring characters side by side."""
        if self.joined.issuperset(zip(word, word[1:], strict=False)):
            return [word]
        at = [0, *(k for k, ab in enumerate(zip(word, word[1:], strict=False), 1) if ab not in self.joined), len(word)]
        return [word[a:b] for a, b in zip(at, at[1:], strict=False)]

    def begins(self, raw: np.ndarray) -> np.ndarray:
        """Of each byte of UTF-8, whose marks are spaces, whether a unit begins there, as `units` cuts words: at a space behind another character, and where no piece holds two characters side by side."""
        on = np.ones(len(raw), bool)
        if len(raw) == 0 or raw.max() < 128:
            on[1:] = self.apart[raw[:-1], raw[1:]]
            return on
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        chars = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
        a, b = chars[:-1], chars[1:]
        apart = np.ones(len(a), bool)
        plain = (a < 128) & (b < 128)
        apart[plain] = self.apart[a[plain], b[plain]]
        odd = np.flatnonzero(~plain)
        if len(self.together):
            keys = a[odd].astype(np.int64) << 32 | b[odd]
            apart[odd] = self.together[np.minimum(np.searchsorted(self.together, keys), len(self.together) - 1)] != keys
        on[:] = False
        on[at[1:][apart]] = on[0] = True
        return on

    def spine(self, i: int) -> tuple[list, list]:
        """Parts of piece i at its right and left border, outermost first: (id, born, gone) as merging goes."""
        found = self.spines.get(i)
        if found is None:
            parts = [(c, 0.0, None, None) for c in self.pieces[i]]  # text, born, left, right
            while len(parts) > 1:
                best = min(((self.rank[self.ids[parts[k][0] + parts[k + 1][0]]], k) for k in range(len(parts) - 1) if parts[k][0] + parts[k + 1][0] in self.ids), default=None)
                if best is None:
                    break
                rank, k = best
                x, y = parts[k : k + 2]
                parts[k : k + 2] = [(x[0] + y[0], max(rank, x[1], y[1]), x, y)]
            sides = []
            for side in (3, 2):
                out, node, gone = [], parts[0], float("inf")
                while node is not None:
                    out.append((node[0], node[1], gone))
                    node, gone = node[side], node[1]
                sides.append(out)
            found = self.spines[i] = tuple(sides)
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging keeps pieces a and b apart: no part at a's right border merges with one at b's left before it is gone."""
        if a < 0 or b < 0:
            return True
        ids, rank, right = self.ids, self.rank, self.spine(b)[1]
        for x, x_born, x_gone in self.spine(a)[0]:
            for y, y_born, y_gone in right:
                i = ids.get(x + y)
                # Of equal merges the left one goes first: inside a before across, across before inside b.
                if i is not None and (at := max(rank[i], x_born, y_born)) < x_gone and at <= y_gone:
                    return False
        return True

    def all_compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`compatible` of many pairs."""
        if self.pair_keys is None:  # answers by a hash of the pair; a later pair takes an earlier one's place
            self.pair_keys, self.pair_fits = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        key = (a.astype(np.int64) << 32) | b
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        some = (a >= 0) & (b >= 0)
        fits = np.where(some, self.pair_fits[slot], True)
        new = np.flatnonzero(some & (self.pair_keys[slot] != key))
        if len(new):
            first, back = np.unique(key[new], return_index=True, return_inverse=True)[1:]
            found = np.array([self.compatible(x, y) for x, y in zip(a[new[first]].tolist(), b[new[first]].tolist(), strict=True)])
            self.pair_keys[slot[new[first]]], self.pair_fits[slot[new[first]]] = key[new[first]], found
            fits[new] = found[back]
        return fits

    def ends(self, edges: pa.ListArray, block: int) -> pa.ListArray:
        """For each unit its edges that some path may take, by end position, in blocks: length, id, score, and as bits the lengths of left neighbours that they may meet.

        edges: as `edges_of` packs them, among them one at each position that is a character long."""
        cuts = np.asarray(edges.offsets).astype(np.int64) - edges.offsets[0].as_py()
        packed = edges.flatten().to_numpy()
        start, length, i = packed >> 32, (packed >> 24) & 0xFF, packed & 0xFFFFFF
        i = np.where(length > 0, i, -1 - i)  # a character without a piece becomes its bytes
        length = np.maximum(length, 1)
        of = np.repeat(np.arange(len(edges)), np.diff(cuts))
        sizes = np.bincount(of[length == 1], minlength=len(edges))
        base = np.cumsum(sizes + 1) - sizes - 1  # positions count through the units, with one between them
        begin = base[of] + start
        order = np.argsort(begin + length, kind="stable")
        begin, length, i = begin[order], length[order], i[order]
        end = begin + length
        lo, hi = np.searchsorted(end, begin), np.searchsorted(end, begin, side="right")
        left = hi - lo
        right_of = np.repeat(np.arange(len(end)), left)
        left_of = np.repeat(lo - (np.cumsum(left) - left), left) + np.arange(left.sum())
        bits = self.all_compatible(i[left_of], i[right_of]).astype(np.int64) << length[left_of]
        ok = np.zeros(len(end), np.int64)
        if len(bits):
            ok[left > 0] = np.add.reduceat(bits, (np.cumsum(left) - left)[left > 0])
        ok |= 1  # the start of the unit
        # What may meet no edge on its left lies on no path.
        alive = (ok > 1) | (start[order] == 0)
        end, length, i, ok = end[alive], length[alive], i[alive], ok[alive]
        score = np.where(i >= 0, self.scores[np.maximum(i, 0)], self.scores.min())
        first = np.cumsum(sizes) - sizes
        positions = np.arange(sizes.sum()) - np.repeat(first - base - 1, sizes)
        offsets = np.append(np.searchsorted(end, positions), len(end)).astype(np.int32)
        cols = [pa.array(x.astype(np.int32)) for x in (length, i, ok)] + [pa.array(score)]
        found = pa.StructArray.from_arrays(cols, ["length", "id", "ok", "score"])
        blocks = -(-sizes // block)
        nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        of_block = np.append(np.repeat(first, blocks) + nth * block, sizes.sum()).astype(np.int32)
        rows = pa.ListArray.from_arrays(pa.array(of_block), pa.ListArray.from_arrays(pa.array(offsets), found))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(blocks)).astype(np.int32)), rows)

    def read(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all tokens, one after another, and where each one's begin; a character without a piece becomes its bytes' ids."""
        ends = np.append(0, np.cumsum([len(t) // 3 for t in tokens])).astype(np.int64)
        raw = np.frombuffer(b"".join(tokens), np.uint8).reshape(-1, 3)
        ids = np.zeros((len(raw), 4), np.uint8)
        ids[:, 2::-1] = raw
        ids = ids.view("<i4").ravel()
        if len(other := np.flatnonzero(ids >= OTHER)):
            each = [[self.bytes[b] for b in chr(i - OTHER).encode("utf-8", "surrogatepass")] for i in ids[other].tolist()]
            many = np.ones(len(ids), np.int64)
            many[other] = [len(x) for x in each]
            ids, after = np.repeat(ids, many), np.append(0, np.cumsum(many))
            ids[_expanded(other, after)] = [i for x in each for i in x]
            ends = after[ends]
        return ids, ends


def words_of(text: str | None) -> list[str]:
    """The text with marks for spaces, cut before each run of marks."""
    if not text:
        return []
    parts = text.replace(SPACE, " ").split(" ")
    if "" not in parts:
        return [SPACE + p for p in parts]
    return re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + SPACE.join(parts))


def pieces(spark: SparkSession, model: str) -> DataFrame:
    """piece, id: as many rows as the model has pieces."""
    return spark.createDataFrame(pa.table({"piece": list(_load(model).ids), "id": pa.array(_load(model).ids.values(), pa.int32())}))


def heads(spark: SparkSession, model: str) -> DataFrame:
    """head, most: the first HEAD characters of pieces, and the length of the longest piece that begins so."""
    most: dict[str, int] = {}
    for p in _load(model).ids:
        if len(p) >= HEAD:
            most[p[:HEAD]] = max(most.get(p[:HEAD], 0), len(p))
    return spark.createDataFrame(pa.table({"head": list(most), "most": pa.array(most.values(), pa.int32())}))


def _name(unit: str) -> str:
    """What a unit goes by: itself, or a digest where it is long."""
    return unit if len(unit) <= NAME else "#" + hashlib.sha256(unit.encode("utf-8", "surrogatepass")).hexdigest()


def _units(texts: pa.Array, merges: Merges) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts, with spaces for marks, and the number of units of each text."""
    texts = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ")
    texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise("", texts, " "))
    ends = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))).astype(np.int64)
    if ends[-1] == 0:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    first = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[first : first + ends[-1]]
    on = merges.begins(raw)
    on[ends[:-1][ends[1:] > ends[:-1]]] = True
    at = np.flatnonzero(on)
    found = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(raw)).astype(np.int32)), pa.py_buffer(raw))
    return found, np.diff(np.searchsorted(at, ends))


def _expanded(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The places of all that each code stands for, offsets[code] to offsets[code + 1], one after another."""
    many = np.diff(offsets)[codes]
    return np.repeat(offsets[codes] - (np.cumsum(many) - many), many) + np.arange(many.sum())


def _chunks(rows: DataFrame, model: str, s: Settings) -> DataFrame:
    """rows: id, text. A row for each chunk: ids; sizes (units of each text); codes (of the units of all its texts, each in as many bytes as the largest takes, little-endian); packed (its units, home by home,
    in the order of their codes, of which `first` is the home's first; a unit holds no space); long (name, full text and code of its long units)."""

    def coded(units: dict[str, int], ids: list[pa.Array], sizes: list[np.ndarray], codes: list[np.ndarray]) -> pa.RecordBatch:
        # Units are numbered home by home and by name, so that neighbours begin alike; a home's names go to the grouping in one string.
        full = pc.replace_substring(pa.array(units, pa.string()), " ", SPACE)
        names = full.to_pylist()
        long_ = {k: names[k] for k in np.flatnonzero(pc.utf8_length(full).to_numpy(zero_copy_only=False) > NAME).tolist()}
        for k in long_:
            names[k] = _name(names[k])
        home = np.array([zlib.crc32(n.encode("utf-8", "surrogatepass")) % homes for n in names], np.int64)
        order = pc.sort_indices(pa.array(names, pa.string())).to_numpy().astype(np.int64)
        order = order[np.argsort(home[order], kind="stable")]
        place = np.empty(len(names), "<u4")
        place[order] = np.arange(len(names), dtype=np.uint32)
        long_ = [{"name": names[k], "text": t, "no": int(place[k])} for k, t in long_.items()]
        names, home = [names[k] for k in order.tolist()], home[order]
        cut = np.flatnonzero(np.r_[True, home[1:] != home[:-1], True]) if len(home) else np.zeros(1, int)
        packed = [{"home": int(home[i]), "first": i, "names": " ".join(names[i:j])} for i, j in zip(cut.tolist(), cut[1:].tolist(), strict=False)]
        width = max(1, -(-(len(names) - 1).bit_length() // 8)) if names else 1
        bytes_ = b"".join(place[c].view(np.uint8).reshape(-1, 4)[:, :width].tobytes() for c in codes)
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        ids = pa.chunked_array(ids, id_type).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), one(np.concatenate(sizes), pa.int32()), pa.array([bytes_], pa.binary()), one(packed, packed_type), one(long_, long_type)],
            names=["ids", "sizes", "codes", "packed", "long"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, part = _load(model), min(PART, s.chunk)
        units, ids, sizes, codes, size = {}, [], [], [], 0
        for b in batches:
            lengths = pc.fill_null(pc.utf8_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            a = 0
            while a < b.num_rows:
                z = min(b.num_rows, a + 1 + int(np.searchsorted(np.cumsum(lengths[a:]), part)))
                found, many = _units(b.column(1).slice(a, z - a), merges)
                found = found.dictionary_encode()
                number = np.array([units.setdefault(u, len(units)) for u in found.dictionary.to_pylist()], np.int32)
                ids.append(b.column(0).slice(a, z - a)), sizes.append(many), codes.append(number[found.indices.to_numpy()])
                size += int(lengths[a:z].sum())
                a = z
                if size >= s.chunk or len(units) >= UNITS:
                    yield coded(units, ids, sizes, codes)
                    units, ids, sizes, codes, size = {}, [], [], [], 0
                    pa.default_memory_pool().release_unused()  # a worker lives on, in stages that want the room
        if ids:
            yield coded(units, ids, sizes, codes)
        pa.default_memory_pool().release_unused()

    kind = rows.schema["id"].dataType
    id_type = to_arrow_type(kind)
    homes = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed_type, long_type = pa.struct([("home", pa.int32()), ("first", pa.int32()), ("names", pa.string())]), pa.struct([("name", pa.string()), ("text", pa.string()), ("no", pa.int32())])
    fields = "packed array<struct<home:int,first:int,names:string>>, long array<struct<name:string,text:string,no:int>>"
    return rows.mapInArrow(run, f"ids array<{kind.simpleString()}>, sizes array<int>, codes binary, {fields}")


EDGE = "struct<length:int,id:int,ok:int,score:double>"
BEST = "struct<score:double,length:int,id:int>"
HOLDERS = "array<struct<chunk:bigint,no:int>>"


def edges_of(units: DataFrame, model: str, s: Settings) -> DataFrame:
    """units: home, name, text, holders; rows of a home stay where they are. name, holders, edges: the lattice of each unit. An edge is a long: 32 bits of start, 8 of length, 24 of id; or length 0 and
    the code point of a character without a piece."""
    longest = _load(model).longest
    is_long = F.length("text") > s.block
    cut = F.when(is_long, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{s.block}}}"), F.lit(0)))
    part = lambda i: F.concat(F.get("cut", i), F.coalesce(F.substring(F.get("cut", i + 1), 1, longest - 1), F.lit("")))
    parts = F.transform(F.sequence(F.lit(0), F.size("cut") - 1), lambda i: F.struct((i * s.block).alias("base"), part(i).alias("part"), F.length(F.get("cut", i)).alias("own")))
    whole = F.array(F.struct(F.lit(0).alias("base"), F.col("text").alias("part"), F.length("text").alias("own")))
    blocks = units.select("home", "name", "holders", "text", cut.alias("cut")).select("home", "name", "holders", F.inline(F.when(is_long, parts).otherwise(whole)))
    starts = blocks.select("home", "name", "holders", "base", "part", F.explode(F.sequence(F.lit(1), "own")).alias("at"))
    # Shorter than HEAD all substrings are looked up, from there on only as far as a piece begins like them.
    headed = starts.withColumn("head", F.substring("part", F.col("at"), F.lit(HEAD))).join(F.broadcast(heads(units.sparkSession, model)), "head", "left")
    reach = F.least(F.coalesce("most", F.lit(HEAD - 1)), F.length("part") - F.col("at") + 1)
    spans = headed.select("home", "name", "holders", "base", "part", "at", F.explode(F.sequence(F.lit(1), reach)).alias("n"))
    spans = spans.select("home", "name", "holders", (F.col("base") + F.col("at") - 1).alias("start"), "n", F.col("part").substr(F.col("at"), F.col("n")).alias("piece"))
    found = spans.join(F.broadcast(pieces(units.sparkSession, model)), "piece", "left").filter("id IS NOT NULL OR n = 1")
    edge = F.when(F.col("id").isNull(), F.ascii("piece").cast("long")).otherwise(F.shiftleft(F.col("n").cast("long"), 24) + F.col("id"))
    packed = F.shiftleft(F.col("start").cast("long"), 32) + edge
    return found.groupBy("home", "name").agg(F.first("holders").alias("holders"), F.collect_list(packed).alias("edges")).drop("home")


def segment(units: DataFrame, model: str, s: Settings) -> DataFrame:
    """units: home, name, text, holders. name, holders, tokens: the ids of each unit, as `Merges.read` takes them."""
    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _load(model)
        for b in batches:
            for a in range(0, b.num_rows, 2000):
                part = b.slice(a, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), merges.ends(part.column(2), s.block)], names=["name", "holders", "blocks"])

    ordered = edges_of(units, model, s).mapInArrow(order, f"name string, holders {HOLDERS}, blocks array<array<array<{EDGE}>>>")
    # State of the inner fold: the best last edge of each prefix in reach, then of the block's prefixes.
    reach, forbidden = _load(model).longest, -1e15
    state_of = lambda score, length, i: F.struct(score.alias("score"), length.alias("length"), i.alias("id"))

    def position(last, here):
        before = lambda e: F.get(last, F.size(last) - e["length"])
        fits = lambda e: F.coalesce(F.call_function("shiftright", e["ok"], before(e)["length"]), F.lit(0)).bitwiseAND(F.lit(1)) == 1
        total = lambda e: F.coalesce(before(e)["score"], F.lit(forbidden)) + e["score"] + F.when(fits(e), F.lit(0.0)).otherwise(F.lit(forbidden))
        return F.concat(last, F.array(F.array_max(F.transform(here, lambda e: state_of(total(e), e["length"], e["id"])))))

    none, origin = state_of(F.lit(forbidden), F.lit(31), F.lit(0)), state_of(F.lit(0.0), F.lit(0), F.lit(0))
    start = F.concat(F.array_repeat(none, reach - 1), F.array(origin)).cast(f"array<{BEST}>")
    state = F.struct(start.alias("tail"), F.array().cast(f"array<array<{BEST}>>").alias("done"))

    def one_block(acc, block):
        folded = F.aggregate(block, acc["tail"], position)
        return F.struct(F.slice(folded, -reach, reach).alias("tail"), F.concat(acc["done"], F.array(F.slice(folded, reach + 1, F.size(block)))).alias("done"))

    alone = F.slice(F.aggregate(F.get("blocks", F.lit(0)), F.array(origin).cast(f"array<{BEST}>"), position), F.lit(2), F.size(F.get("blocks", F.lit(0))))
    many = F.aggregate("blocks", state, one_block, lambda acc: acc["done"])
    folded = ordered.select("name", "holders", F.when(F.size("blocks") == 1, F.array(alone)).otherwise(many).alias("last"))

    # From the end of the unit back to its start, block by block: an edge's own positions are skipped. A token is written as six hex digits.
    def step(acc, e):
        i = F.when(e["id"] < 0, F.lit(OTHER - 1) - e["id"]).otherwise(e["id"])
        token = F.lpad(F.hex(i.cast("long")), 6, "0")
        return F.when(acc["skip"] > 0, F.struct((acc["skip"] - 1).alias("skip"), acc["tokens"].alias("tokens"))).otherwise(
            F.struct((e["length"] - 1).alias("skip"), F.concat(token, acc["tokens"]).alias("tokens")))

    def block_back(acc, block):
        zero = F.struct(acc["skip"].alias("skip"), F.lit("").alias("tokens"))
        return F.aggregate(F.reverse(block), zero, step, lambda x: F.struct(x["skip"].alias("skip"), F.concat(F.array(x["tokens"]), acc["done"]).alias("done")))

    none_yet = F.struct(F.lit(0).alias("skip"), F.array().cast("array<string>").alias("done"))
    tokens = F.aggregate(F.reverse("last"), none_yet, block_back, lambda acc: F.unhex(F.array_join(acc["done"], "")))
    return folded.select("name", "holders", tokens.alias("tokens"))


def _fill(chunks: DataFrame, frequent, kind, model: str, check: bool) -> DataFrame:
    """chunks: ids, sizes, codes, packed, found (four bytes of a unit's code, then its tokens). For each text doc_id, n_tokens, ids_crc32, and ids, or with `check` the checksum of the text that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, merges = frequent.value, _load(model)
        for b in batches:
            for k in range(b.num_rows):
                ids, sizes, packed, found = (b.column(c)[k].values for c in ("ids", "sizes", "packed", "found"))
                tokens = [table.get(u) for names in packed.field("names").to_pylist() for u in names.split(" ")]
                if found is not None:
                    for x in found.to_pylist():
                        tokens[int.from_bytes(x[:4], "big")] = x[4:]
                flat, places = merges.read(tokens)
                del tokens
                ends = np.append(0, np.cumsum(sizes.to_numpy()))
                codes = np.frombuffer(b.column("codes")[k].as_buffer(), np.uint8).reshape(int(ends[-1]), -1) if ends[-1] else np.empty((0, 1), np.uint8)
                for a in range(0, len(ids), 200):
                    z = min(len(ids), a + 200)
                    some = np.zeros((ends[z] - ends[a], 4), np.uint8)
                    some[:, : codes.shape[1]] = codes[ends[a] : ends[z]]
                    some = some.view("<i4").ravel()
                    out = flat[_expanded(some, places)] if len(some) else np.empty(0, "<i4")
                    cuts = np.append(0, np.cumsum(np.diff(places)[some]))[ends[a : z + 1] - ends[a]]
                    each = [out[i:j] for i, j in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
                    crc = pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())
                    if check:
                        last = pa.array([zlib.crc32(decode(x, merges).encode("utf-8", "surrogatepass")) for x in each], pa.int64())
                    else:
                        last = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(out))
                    yield pa.RecordBatch.from_arrays([ids.slice(a, z - a), pa.array(np.diff(cuts)), crc, last], names=["doc_id", "n_tokens", "ids_crc32", "text_crc32" if check else "ids"])

    return chunks.mapInArrow(run, f"doc_id {kind.simpleString()}, n_tokens long, ids_crc32 long, {'text_crc32 long' if check else 'ids array<int>'}")


@contextmanager
def _set(spark: SparkSession, key: str, value: str):
    """A setting of the session, for what is run inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _lexicon(units: list[DataFrame], model: str, s: Settings) -> DataFrame:
    """`segment` of all units, kept. A task groups the edges of thousands of units: they are held in a map, not sorted anew, up to a million."""
    with _set(units[0].sparkSession, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(1 << 20)):
        return kept(reduce(DataFrame.unionAll, (segment(u, model, s) for u in units)), "units")


def _encoded(docs: DataFrame, model: str, id_col: str, text_col: str, s: Settings, check: bool) -> DataFrame:
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    spark = texts.sparkSession
    # Whole texts go to Python: ten thousand of them in one batch would be held several times over.
    with _set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", "4m"):
        chunks = kept_by(_chunks(texts, model, s).withColumn("chunk", F.monotonically_increasing_id()), "chunks", "chunk")
    # Names are shuffled by home, many in a row, and grouped where they are, as are the edges of a unit. holders: the chunks that hold it, and its code there.
    at_home = chunks.select("chunk", F.inline("packed")).repartitionById(int(spark.conf.get("spark.sql.shuffle.partitions")), "home")
    named = at_home.select("home", "chunk", "first", F.posexplode(F.split("names", " ")).alias("nth", "name")).filter(F.length("name") <= NAME)
    short = named.groupBy("home", "name").agg(F.collect_list(F.struct("chunk", (F.col("first") + F.col("nth")).alias("no"))).alias("holders"))
    # What is longer than a name may be is a digest.
    long_ = chunks.select("chunk", F.inline("long")).groupBy("name").agg(F.first("text").alias("text"), F.collect_list(F.struct("chunk", "no")).alias("holders"))
    units = [short.select("home", "name", F.col("name").alias("text"), "holders"), long_.select(F.lit(0).alias("home"), "name", "text", "holders")]
    lexicon = _lexicon(units, model, s)
    # What one chunk only holds is better sent there than to all.
    times = F.size("holders")
    top = lexicon.filter(times > 1).select("name", "tokens", times.alias("times")).orderBy(F.desc("times"), "name").limit(s.frequent).select("name", "tokens").toArrow()
    names = spark.createDataFrame(top.select(["name"]))
    frequent = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))
    sent = lexicon.join(F.broadcast(names), "name", "left_anti").select("tokens", F.inline("holders"))
    found = sent.groupBy("chunk").agg(F.collect_list(F.concat(F.unhex(F.lpad(F.hex("no"), 8, "0")), "tokens")).alias("found"))  # one binary takes half of a struct's room
    whole = chunks.join(found, "chunk", "left").select("ids", "sizes", "codes", "packed", "found")
    return _fill(whole, frequent, texts.schema["id"].dataType, model, check)


def decode(ids: np.ndarray, merges: Merges) -> str:
    """The text of ids, without the space that encoding put before it."""
    raw = merges.flat[_expanded(ids, merges.places)].tobytes() if len(ids) else b""
    return raw.decode("utf-8", "replace").removeprefix(" ")


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """doc_id, ids (array of int), n_tokens, ids_crc32 (of the ids as little-endian 32 bits): one row for each row of docs."""
    return _encoded(docs, model, id_col, text_col, settings or Settings(), check=False).select("doc_id", "ids", "n_tokens", "ids_crc32")


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """encoded: doc_id, ids. doc_id, text: one row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _load(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(x.values.to_numpy(), merges) for x in b.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def encode_and_check(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, text_crc32 (of the decoded text as UTF-8): the digest columns of a round trip, one row for each row of docs."""
    return _encoded(docs, model, id_col, text_col, settings or Settings(), check=True)
