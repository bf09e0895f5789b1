"""What the operators on whole texts share inside a task: chunks of bounded size, words as codes, and the ids of remembered words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def chunks(batches: Iterator[pa.RecordBatch], size: int, rows: int = 1 << 16) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Columns id and text of the batches, in pieces of about `size` bytes of text (a longer text goes alone) and up to `rows` texts; a null text is empty."""
    ids, texts, have, many = [], [], 0, 0
    joined = lambda parts: pa.chunked_array(parts).combine_chunks()
    for b in batches:
        text = pc.fill_null(b.column(1), "")
        lengths, a = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64), 0
        ends = np.cumsum(lengths)
        while a < b.num_rows:
            before = ends[a] - lengths[a]
            z = min(b.num_rows, a + rows - many, max(a + 1, int(np.searchsorted(ends, before + size - have, side="right"))))
            ids.append(b.column(0).slice(a, z - a)), texts.append(text.slice(a, z - a))
            have, many, a = have + int(ends[z - 1] - before), many + z - a, z
            if have >= size or many == rows or a < b.num_rows:
                yield joined(ids), joined(texts)
                ids, texts, have, many = [], [], 0, 0
    if ids:
        yield joined(ids), joined(texts)


def expanded(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The places of all that each code stands for, offsets[code] to offsets[code + 1], one after another."""
    many = np.diff(offsets)[codes]
    return np.repeat(offsets[codes] - (np.cumsum(many) - many), many) + np.arange(many.sum())


def places(lengths) -> np.ndarray:
    return np.append(0, np.cumsum(np.asarray(lengths, np.int64)))


def grouped_sum(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values between ends[k] and ends[k + 1], 0 where there are none."""
    total = places(values)
    return total[ends[1:]] - total[ends[:-1]]


#: Nothing, or white space first: what str.isspace says of one character.
BLANK = r"^(?:[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|$)"


class Spaced:
    """Texts cut at their spaces: `codes` of words (what stands between two spaces), `words` that the codes stand for, `ends` of the texts among the codes.

    `leading` marks texts whose first word is empty or begins with white space. `odd` marks texts that are not safely cut so: those where a space comes before white space or at the end. Tokenizers that tie one space to the word
    behind it encode all others word by word. A text's first word has no space before it."""

    def __init__(self, texts: pa.Array):
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.ends = places(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        self.first = self.ends[:-1]  # a split text has a word at least
        odd = pc.match_substring_regex(coded.dictionary, BLANK).to_numpy(zero_copy_only=False)
        bad = odd[self.codes] if len(self.codes) else np.empty(0, bool)
        self.leading = bad[self.first]
        bad[self.first] = False
        self.odd = grouped_sum(bad, self.ends) > 0
        #: words, with another in place of those that only odd texts hold behind a space.
        self.plain = self.words.copy()
        for k in np.flatnonzero(odd).tolist():
            self.plain[k] = "-"


class Remembered:
    """Values of words by `learn` (words -> values), remembered in two generations of up to `most` words: when the young one is full it takes the old one's
    place, and words of the old one that come again move to the young one."""

    def __init__(self, learn: Callable[[list[str]], list], most: int = 400_000, longest: int = 64):
        self.learn, self.most, self.longest, self.young, self.old = learn, most, longest, {}, {}

    def of(self, words: list[str]) -> list:
        values = list(map(self.young.get, words))
        missing = [k for k, v in enumerate(values) if v is None]
        if not missing:
            return values
        again = list(map(self.old.get, [words[k] for k in missing]))
        new = [k for k, v in zip(missing, again, strict=True) if v is None]
        for k, v in zip(missing, again, strict=True):
            values[k] = v
        for k, v in zip(new, self.learn([words[k] for k in new]) if new else [], strict=True):
            values[k] = v
        if len(self.young) + len(missing) > self.most:
            self.old, self.young = self.young, {}
        self.young.update([(w, values[k]) for k in missing if len(w := words[k]) <= self.longest])
        return values


class SpacedIds:
    """Ids of words with a space before them, by a byte-level BPE of the tokenizers library, as bytes of little-endian 16 or 32 bits."""

    SEPARATE = 2000

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are text
        vocabulary = self.tokenizer.get_vocab()
        self.width = max(vocabulary.values(), default=0) + 1
        self.kind = np.dtype("<u2" if self.width <= 1 << 16 else "<u4")
        self.opens = np.zeros(self.width, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.known = Remembered(self._spaced, most)

    def raw(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as they stand."""
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Many words go to the library as one text, and part again at tokens that open with a space."""
        out, width = [], self.kind.itemsize
        for a in range(0, len(words), self.SEPARATE):
            some = words[a : a + self.SEPARATE]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            cuts = [*(np.flatnonzero(self.opens[ids]) * width).tolist(), len(ids) * width]
            if len(cuts) == len(some) + 1:
                flat = ids.tobytes()
                out += [flat[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
            else:  # among them is one that spaces don't part
                out += self.raw([" " + w for w in some])
        return out

    def of(self, words: list[str]) -> list[bytes]:
        return self.known.of(words)
