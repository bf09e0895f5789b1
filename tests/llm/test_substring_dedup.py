import hashlib
import random

import numpy as np
import pytest

from lumenmart.llm import substring_dedup as sd


def brute(rows, length):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = [True] * length
            seen.add(w)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghé") for _ in range(r.randrange(2, 9))) for _ in range(300)]
    prose = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage, rows = prose(45), []
    for i in range(n):
        kind = r.randrange(7)
        if kind == 0 and rows:
            text = r.choice(rows)[1]
        elif kind == 1 and rows:
            w = (r.choice(rows)[1] or "x y").split(" ")
            w[r.randrange(len(w))] = r.choice(words)
            text = " ".join(w)
        elif kind == 2:
            text = prose(r.randrange(30)) + " " + passage + " " + prose(r.randrange(30))
        elif kind == 3:
            line = prose(r.randrange(3, 20))
            text = "\n".join([line] * r.randrange(1, 9))
        elif kind == 4:
            text = r.choice("ab") * r.randrange(50, 500)
        else:
            text = prose(r.randrange(1, 120))
        rows.append((i, text))
    return [*rows, (n, None), (n + 1, ""), (n + 2, passage[:99]), (n + 3, passage[3:103])]


def test_sliding_minimum():
    x = np.random.default_rng(1).integers(0, 1 << 60, 500).astype(np.uint64)
    assert sd.sliding_minimum(x, 37).tolist() == [int(x[i : i + 37].min()) for i in range(464)]


@pytest.mark.parametrize(("seed", "part"), [(1, 4096), (3, 2)])
def test_equals_brute_force(spark, seed, part):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, sd.remove(docs, settings=sd.Settings(part=part)).collect()))
    assert got == brute(rows, 100)


def test_texts_longer_than_a_piece(spark):
    """Repeats within a piece, across the border of two pieces, and between texts of several pieces."""
    r = random.Random(9)
    prose = "".join(r.choice("abcdefgh ") for _ in range(sd.PIECE + 400_000))
    border = prose[sd.PIECE - 150 : sd.PIECE + 150]
    rows = [(1, prose + border), (2, "x" + border), (3, prose[500_000 : 500_000 + sd.PIECE + 7])]
    got = sorted(map(tuple, sd.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows, 100)


def test_edited_copies_of_one_text(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    base, rows = [r.choice(words) for _ in range(60)], []
    for i in range(500):
        w = [r.choice(words) if r.random() < 0.05 else x for x in base]
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, sd.remove(docs, settings=sd.Settings(part=50)).collect()))
    assert got == brute(rows, 100)


def test_null_and_repeated_ids_empty(spark):
    text = "".join(chr(97 + (k * k) % 26) for k in range(400)) + "é" * 10
    docs = spark.createDataFrame([(None, text), (2**63 - 1, text[3:]), (5, "z" + text), (7, "short"), (7, "short")], "doc_id long, text string")
    got = sorted(map(tuple, sd.remove(docs).collect()), key=str)
    assert got == sorted(brute([(None, text), (2**63 - 1, text[3:]), (5, "z" + text), (7, "short"), (7, "short")], 100), key=str)
    assert sd.remove(docs.limit(0)).count() == 0
