import hashlib
from bisect import bisect_right
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers

from lumenmart.llm import alignment

PATHS = [public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
TEXTS = [
    "The quick  Brown fox", None, "", "tab\tand\nnew\r\nlines", " a", "  a", "a ", "a \n b", "a\n \nb", "it's we'll <|endoftext|> <s> x", "ábc é ́x", "日本語 テキスト。 x", "word,. foo.bar a.,! b",
    "x" * 3000, "   a", " ", "　 a 　b", " 's 's a's", "12 345 ½ ² a½.", "foo\x1c bar \x1cx", "a mark▁inside", "▁", "word " * 3000 + "end", "word " * 3000 + "end", "one two three", "three two one two", "\x00nul \x00", "😀 👩‍👩‍👧 ok",
]


@lru_cache
def tools():
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, decoders.ByteLevel(), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def document(text):
    """Links and groups of a whole text, written from the definition; byte by byte."""
    a, _, b = tools()
    if not text:
        return None
    to_byte, want = alignment.byte_level(), (" " + text).encode()
    e = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(to_byte[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
    right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in zip(b.encode(text), b.encode(text, out_type=str), strict=True)]
    if any(b"".join(x for _, x in side) != want for side in (left, right)):
        return None
    spans = []
    for side in (left, right):
        at, out = 0, []
        for i, x in side:
            out.append((i, at, at + len(x)))
            at += len(x)
        spans.append(out)
    links, k = Counter(), 0
    for i, s, e_ in spans[0]:
        while spans[1][k][2] <= s:
            k += 1
        j = k
        while j < len(spans[1]) and spans[1][j][1] < e_:
            links[i, spans[1][j][0]] += 1
            j += 1
    both = sorted({e_ for _, _, e_ in spans[0]} & {e_ for _, _, e_ in spans[1]})
    cells = [[[], []] for _ in both]
    for side in (0, 1):
        for i, s, _ in spans[side]:
            cells[bisect_right(both, s)][side].append(str(i))
    return len(left), len(right), links, ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in cells), len(both)


def brute(docs):
    each = [(i, document(t)) for i, t in docs]
    held, most = Counter(p for _, d in each if d for p in d[2]), defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    rows = []
    for i, d in each:
        if d is None:
            rows.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, links, groups, n_groups = d
        rows.append((i, n_a, n_b, n_groups, sum(links.values()), sum(m for p, m in links.items() if held[p] == most[p[0]]), sum(m * held[p] for p, m in links.items()), hashlib.sha256(groups.encode()).hexdigest()))
    return sorted(rows, key=str)


def test_equals_brute_force(spark):
    docs = [(5 * k % 101, t) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_a int, pair string").repartition(4)
    want = brute(docs)
    assert sum(r[1] == 0 for r in want) == 4  # null, empty, and the two with a mark
    for frequent in (200_000, 10, 0):
        assert sorted(map(tuple, alignment.align(df, *PATHS, frequent=frequent).collect()), key=str) == want


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sorted(map(tuple, alignment.align(docs, *PATHS, frequent=500).collect()), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_nulls_repeats_empty(spark):
    docs = [(None, "one two"), (1, "two"), (1, "two"), (2, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, alignment.align(df, *PATHS).collect()), key=str) == brute(docs)
    assert alignment.align(df.limit(0), *PATHS).count() == 0


def test_bitmaps_round_trip():
    rng = np.random.default_rng(0)
    key = np.unique(np.concatenate([rng.integers(0, 50 * alignment.BLOCK, 500), np.arange(7 * alignment.BLOCK, 8 * alignment.BLOCK, 2), 9 * alignment.BLOCK + np.arange(255), 20 * alignment.BLOCK + np.arange(256)]))
    of, place = np.divmod(key, alignment.BLOCK)
    bitmaps = alignment.packed(of, place, 60)
    assert len(bitmaps) == 60 and max(map(len, bitmaps.to_pylist())) == alignment.PLAIN
    back_of, back_place = alignment.unpacked(bitmaps)
    assert sorted(zip(back_of.tolist(), back_place.tolist(), strict=True)) == list(zip(of.tolist(), place.tolist(), strict=True))
