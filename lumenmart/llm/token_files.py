"""Token ids in Arrow IPC files of equal-length sequences.

A shard is an Arrow stream with a footer (the IPC file format), so a reader maps the file and takes any sequence without
copying: record batches of `ids` (fixed_size_list<uint16>[length]; uint32 for vocabularies of over 65,536) and `mask`
(fixed_size_list<bool>[length], a bit a token, false for padding). A shard's documents follow each other without gaps, cut into sequences of equal length; only its last sequence
is padded. Beside it, `<shard>.docs.arrow` has doc_id, start (within the shard) and n_tokens of each document.

Documents are dealt to shards by ranges of ascending id, each shard is written by one task, and a task's files appear under
their final names only when complete, so a task that runs again (or twice) leaves the same files. Where a shard's ids start
in the whole corpus follows from the shards' totals, one row a shard.

Texts are encoded with the tokenizers library. Where the tokenizer drops spaces between words (as word_bpe_49k.json does), the different
pieces between spaces of a chunk of texts are cut into words, which are encoded once and remembered, in two generations of bounded size: no
token spans two words, so the ids are those of the whole text, which the tests hold against whole texts.

Defined results: a null text is empty and has the end id alone; null ids come first; rows that repeat an id follow each other in
any order; an empty table writes no file and gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenmart.llm.chunks import Remembered, chunks, expanded, places
from lumenmart.llm.common import kept, scratch

#: Bytes of text that are encoded together.
CHUNK = 4 << 20
MANIFEST = "shard int, path string, docs long, tokens long"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _open_fs(uri: str):
    return arrow_fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


#: Fixed value: how word_bpe_49k.json cuts lower-case words, said for the characters of PLAIN.
WORDS = r"('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-įı-ňŋ-ž]+|[0-9]|[!-/:-@\[-`{-~]+)"
#: Characters whose normal form, lower case and kind Arrow and the tokenizer agree on: ASCII and composed Latin letters.
PLAIN = r"^[!-~À-ÖØ-öø-įı-ňŊ-ž]*$"


class Encoder:
    """Ids of whole texts. by_space: encode what stands between spaces, by words where that is safe, and remember the words; unseen ones go to
    the library together, apart by spaces, and part again at tokens that end a word."""

    def __init__(self, path: str, by_space: bool = True, remembered: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_space = Tokenizer.from_file(path), by_space
        vocabulary = self.tokenizer.get_vocab()
        self.width = max(vocabulary.values(), default=0) + 1
        self.ends = np.zeros(self.width, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words = Remembered(self._learn, remembered)

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> list[bytes]:
        there, out = [w for w in words if w], []
        for a in range(0, len(there), 2000):
            some = there[a : a + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            cuts = np.append(0, np.flatnonzero(self.ends[ids]) + 1).tolist()
            raw = ids.tobytes()
            parts = [raw[4 * i : 4 * j] for i, j in zip(cuts, cuts[1:], strict=False)]
            out += parts if len(parts) == len(some) else self._raw(some)
        each = iter(out)
        return [next(each) if w else b"" for w in words]

    @staticmethod
    def _flat(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(raw), "<u4"), places([len(x) // 4 for x in raw])

    @staticmethod
    def _spread(split: pa.Array, codes: np.ndarray, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each list of codes, one after another, and where each list's begin and end, from those of each code."""
        return flat[expanded(codes, at)], places(np.diff(at)[codes])[places(pc.list_value_length(split).to_numpy(zero_copy_only=False))]

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and their places, first of the pieces that are cut into words, then of the others; and where among these each piece stands."""
        plain = pc.and_not(pc.match_substring_regex(pieces, PLAIN), pc.match_substring(pieces, "<|"))
        cut = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(pieces.filter(plain)), WORDS, r"\1 "), " ")
        coded = cut.flatten().dictionary_encode()
        words, ends = self._spread(cut, coded.indices.to_numpy(zero_copy_only=False), *self._flat(self.words.of(coded.dictionary.to_pylist())))
        others, more = self._flat(self._raw(pieces.filter(pc.invert(plain)).to_pylist()))
        order, first = np.empty(len(pieces), np.int64), plain.to_numpy(zero_copy_only=False)
        order[first], order[~first] = np.arange(len(ends) - 1), len(ends) - 1 + np.arange(len(more) - 1)
        return np.concatenate([words, others]), np.concatenate([ends, ends[-1] + more[1:]]), order

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin and end."""
        if not self.by_space:
            return self._flat(self._raw(texts.to_pylist()))
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        flat, at, order = self._pieces(coded.dictionary)
        return self._spread(split, order[coded.indices.to_numpy(zero_copy_only=False)], flat, at)


@lru_cache(maxsize=2)
def encoder(path: str, by_space: bool) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path, by_space)


def shard_schema(length: int, width: int) -> pa.Schema:
    """width: number of ids; 16 bits do for up to 65,536."""
    return pa.schema([("ids", pa.list_(pa.uint16() if width <= 1 << 16 else pa.uint32(), length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Writes one shard; both files get their final names in `close`."""

    def __init__(self, where: str, shard: int, length: int, width: int = 1 << 32, sequences: int = 1024):
        self.fs, root = _open_fs(where)
        self.fs.create_dir(root, recursive=True)
        self.final, tag = f"{root}/shard-{shard:06d}", uuid.uuid4().hex
        self.paths = {f"{root}/_tmp-{shard:06d}-{tag}.arrow": f"{self.final}.arrow", f"{root}/_tmp-{shard:06d}-{tag}.docs.arrow": f"{self.final}.docs.arrow"}
        self.length, self.sequences, self.schema = length, sequences, shard_schema(length, width)
        self.kind = np.uint16 if width <= 1 << 16 else np.uint32
        self.files = [self.fs.open_output_stream(p) for p in self.paths]
        self.seqs, self.index = pa.ipc.new_file(self.files[0], self.schema), pa.ipc.new_file(self.files[1], INDEX)
        self.waiting, self.n_waiting, self.tokens, self.docs = [], 0, 0, 0

    def add(self, doc_ids: list, ids: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        starts = self.tokens + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
        self.index.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=INDEX))
        self.waiting += ids
        self.n_waiting += int(sizes.sum())
        self.tokens, self.docs = self.tokens + int(sizes.sum()), self.docs + len(ids)
        if self.n_waiting >= self.length * self.sequences:
            self._write(last=False)

    def _write(self, last: bool) -> None:
        flat = np.concatenate(self.waiting) if self.waiting else np.empty(0, "<u4")
        whole = -(-len(flat) // self.length) if last else len(flat) // self.length
        full, rest = flat[: whole * self.length], flat[whole * self.length :]
        for a in range(0, whole, self.sequences):
            part = full[a * self.length : (a + self.sequences) * self.length]
            rows = -(-len(part) // self.length)
            ids, mask = np.zeros(rows * self.length, self.kind), np.zeros(rows * self.length, bool)
            ids[: len(part)], mask[: len(part)] = part, True
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
            self.seqs.write_batch(pa.record_batch(lists, schema=self.schema))
        self.waiting, self.n_waiting = [rest], len(rest)

    def close(self) -> str:
        self._write(last=True)
        for x in (self.seqs, self.index, *self.files):
            x.close()
        for a, b in self.paths.items():
            self.fs.move(a, b)
        return f"{self.final}.arrow"


def write(docs: DataFrame, where: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, length: int = 512, by_space: bool = True, shards: int | None = None) -> DataFrame:
    """Writes all docs below `where` (a shared folder); returns shard, path, docs, tokens, base (ids in all shards before)."""
    spark = docs.sparkSession
    n = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).repartitionByRange(n, "id").sortWithinPartitions("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, own, out = TaskContext.get().partitionId(), encoder(tokenizer, by_space), None
        end = np.array([end_id], dtype="<u4")
        for ids, texts in chunks(batches, CHUNK):
            out = out or ShardWriter(where, shard, length, own.width)
            flat, at = own.encode_all(texts)
            out.add(ids.to_pylist(), [np.append(flat[i:j], end) for i, j in itertools.pairwise(at.tolist())])
        if out:
            path = out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "docs": [out.docs], "tokens": [out.tokens]})

    manifest = kept(ranged.mapInArrow(run, MANIFEST), "manifest")
    # One row a shard: the window has as many rows as there are files.
    return manifest.withColumn("base", F.sum("tokens").over(Window.partitionBy(F.lit(0)).orderBy("shard")) - F.col("tokens"))


class ShardReader:
    """Random access to a shard: local files are mapped, so slices are views; others are read batch by batch."""

    def __init__(self, path: str):
        self.fs, name = _open_fs(path)
        local = isinstance(self.fs, arrow_fs.LocalFileSystem)
        opened = (lambda p: pa.memory_map(p)) if local else self.fs.open_input_file
        self.seqs, self.index = pa.ipc.open_file(opened(name)), pa.ipc.open_file(opened(f"{name.removesuffix('.arrow')}.docs.arrow"))
        self.length = self.seqs.schema.field("ids").type.list_size
        self.rows = [self.seqs.get_batch(i).num_rows for i in range(self.seqs.num_record_batches)]
        self.first = [0, *itertools.accumulate(self.rows)]

    def batch(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """ids and mask of batch i, flat, as views of the file."""
        b = self.seqs.get_batch(i)
        return b.column(0).flatten().to_numpy(zero_copy_only=True), b.column(1).flatten()

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        i = int(np.searchsorted(self.first, k, side="right")) - 1
        ids, mask = self.batch(i)
        a = (k - self.first[i]) * self.length
        return ids[a : a + self.length], mask.slice(a, self.length)

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """doc_id, start, ids, in order; holds the batches of one document at most."""
        at, held, held_from = 0, np.empty(0, "<u4"), 0
        for k in range(self.index.num_record_batches):
            for r in zip(*(c.to_pylist() for c in self.index.get_batch(k).columns), strict=True):
                doc_id, start, n = r
                parts = [held[start - held_from :]]
                have = len(parts[0])
                while have < n:
                    ids, mask = self.batch(at)
                    ids, at = ids[: mask.true_count], at + 1
                    parts.append(ids.astype("<u4"))
                    have += len(ids)
                held, held_from = (np.concatenate(parts) if len(parts) > 1 else parts[0]), start
                yield doc_id, start, held[:n]


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files that the manifest names; a file is one task's."""
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                documents = ShardReader(path).documents()
                while rows := [(d, base + s, len(x), zlib.crc32(x.tobytes())) for d, s, x in itertools.islice(documents, 5000)]:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("path", "base").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer: str, where: str | None = None, **options) -> DataFrame:
    return read(write(docs, where or scratch(docs.sparkSession, "tokens"), tokenizer, **options))
