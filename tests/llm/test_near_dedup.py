import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lumenmart.llm import near_dedup
from lumenmart.llm.graphs import components


def shingles(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jp(x, y):
    if set(x.values()) | set(y.values()) == {1}:
        return len(x.keys() & y.keys()) / len(x.keys() | y.keys())
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in set(x) | set(y)) for i in set(x) & set(y))


def brute(rows):
    """Classes over all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if rows[i] == rows[j] or (sets[i] and sets[j] and jp(sets[i], sets[j]) >= 0.8):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, least[find(k)]) for k, (i, _) in enumerate(rows))


def corpus():
    r = random.Random(5)
    vocabulary = ["w%x" % r.randrange(1 << 20) for _ in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([8, 60, 120]))]
        for _ in range(r.choice([1, 1, 3, 12])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            rows.append((n, " ".join(t).replace(" w", ", W", 1)))
            n += 1
    chain = [r.choice(vocabulary) for _ in range(100)]
    for _ in range(30):  # each like the next, the ends unlike
        chain[r.randrange(100)] = r.choice(vocabulary)
        rows.append((n, " ".join(chain)))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "!!"), (n + 3, "two words"), (n + 4, "Two, words"), (n + 5, "rep " * 50_000), (n + 6, "rep " * 49_999), (n + 5, "rep " * 50_000)]
    return rows


def test_probability_jaccard():
    r = random.Random(1)
    for _ in range(50):
        x, y = (Counter({k: r.randint(1, 4) for k in r.sample(range(12), r.randint(1, 9))}) for _ in range(2))
        a, b = (np.array(sorted(c)) for c in (x, y))
        got = near_dedup.similarity(a, np.array([x[k] for k in a.tolist()]), b, np.array([y[k] for k in b.tolist()]))
        assert abs(got - jp(x, y)) < 1e-9


def test_registers_estimate_it():
    r = np.random.default_rng(3)
    x, y = {int(k): int(r.integers(1, 5)) for k in range(1000, 1040)}, {int(k): int(r.integers(1, 5)) for k in range(1010, 1050)}
    of = np.array([0] * 40 + [1] * 40)
    held = near_dedup.registers(of, near_dedup.mixed(np.array([*x, *y], np.uint64)), np.array([*x.values(), *y.values()]), 2, 4000)
    assert abs((held[0] == held[1]).mean() - jp(Counter(x), Counter(y))) < 0.03


def test_classes_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).repartition(3)
    assert sorted((r.doc_id, r.class_id) for r in near_dedup.classes(docs).collect()) == brute(rows)


def edited(r, words, share, vocabulary):
    return [r.choice(vocabulary) if r.random() < share else w for w in words]


def test_edited_copies_of_one_text(spark):
    """A large group whose members are alike to all degrees: the classes are those of brute force over all pairs."""
    r = random.Random(11)
    vocabulary = ["v%x" % r.randrange(1 << 20) for _ in range(3000)]
    base = [r.choice(vocabulary) for _ in range(80)]
    rows = [(i, " ".join(edited(r, base, r.choice([0.004, 0.02, 0.05]), vocabulary))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((x.doc_id, x.class_id) for x in near_dedup.classes(docs).collect()) == brute(rows)


def test_recall_of_pairs():
    """Of pairs at 0.8 to 0.9, the share that has a band in common and passes the sketches."""
    r, s = random.Random(2), near_dedup.Settings()
    vocabulary, near, found = ["v%x" % r.randrange(1 << 20) for _ in range(5000)], 0, 0
    for _ in range(700):
        a = [r.choice(vocabulary) for _ in range(150)]
        b = edited(r, a, 0.025, vocabulary)
        of, sh, w = near_dedup.weighted([" ".join(a), " ".join(b)], 5)
        if 0.8 <= jp(shingles(" ".join(a)), shingles(" ".join(b))) <= 0.9:
            held = near_dedup.registers(of, sh, w, 2, s.registers)
            keys = near_dedup.band_keys(held, s.places())
            same = ((near_dedup.mixed(held[0]) ^ near_dedup.mixed(held[1])) & np.uint64(255) != 0).sum() <= s.most_different
            near += 1
            found += bool((keys[0] == keys[1]).any() and same)
    assert near > 150 and found / near > 0.95, (near, found)


def test_deduplicate_and_empty(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, base, "x"), (2, base + " end", "y"), (3, "other text of at least five words", "z"), (None, base, "n"), (4, None, "e"), (1, base, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, content string")
    got = near_dedup.deduplicate(docs)
    assert got.columns == docs.columns and sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "4", "None"]
    assert near_dedup.classes(docs.limit(0)).count() == 0 and near_dedup.deduplicate(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 30)] + [(100, 101), (100, 102), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 1 for k in range(1, 31)) and got[101] == got[102] == 100 and got[200] == 200


def test_rounds_read_on_only_what_can_meet(spark):
    """Of a bucket the easy round keeps the members outside its largest component, a full round buckets with a pivot; over all full rounds each pair comes once."""
    s = near_dedup.Settings()
    rows = [(1, bytes([k]), b"a" if k < 4 else b"e") for k in range(5)] + [(2, bytes([k]), b"a") for k in range(3)]
    members = spark.createDataFrame(rows, "key long, node binary, root binary")
    sketches = spark.createDataFrame([(bytes([k]), [0] * 32) for k in range(5)], "node binary, registers array<long>")
    read, pairs = near_dedup._easy_round(members, sketches, s, 0)
    assert (read[0].count(), pairs.count()) == (1, 1)
    kept, met = 0, []
    for low, high in zip((0.0, *s.shares), s.shares, strict=False):
        read, pairs = near_dedup._full_round(members, sketches, s, low, high)
        kept += read[0].count()
        met += [(bytes(r.a), bytes(r.b)) for r in pairs.collect()]
    assert kept < 5 * len(s.shares) and sorted(met) == [(bytes([k]), bytes([4])) for k in range(4)]


def test_full_rounds_read_the_largest_component_once(spark):
    """Over all full rounds each member of a bucket's largest component is read once, and each pair of the components of the start comes once, also where the largest one changes meanwhile."""
    s = near_dedup.Settings()
    first = lambda k: b"a" if k < 40 else b"e" if k < 43 else bytes([k])
    members = spark.createDataFrame([(1, bytes([k]), first(k)) for k in range(45)], "key long, node binary, root binary")
    sketches = spark.createDataFrame([(bytes([k]), [0] * 32) for k in range(45)], "node binary, registers array<long>")
    shares, read_on, met = list(zip((0.0, *s.shares), s.shares, strict=False)), 0, []
    for low, high in shares:
        read, pairs = near_dedup._full_round(members, sketches, s, low, high)
        read_on += read[0].count()
        met += [(r.a[0], r.b[0]) for r in pairs.collect()]
    assert sorted(met) == [(x, y) for x in range(45) for y in range(x + 1, 45) if first(x) != first(y)]
    assert read_on == 40 + 5 * len(shares)
    opened, met = near_dedup._opened(members, sketches), set()
    for k, (low, high) in enumerate(shares):  # of round 2 on all are apart: none of the pairs of the start is lost
        roots = members.select("node", "root" if k < 2 else F.col("node").alias("root"))
        read, pairs = near_dedup._full_round(roots, sketches, s, low, high, opened)
        met |= {(r.a[0], r.b[0]) for r in pairs.collect()}
    assert met >= {(x, y) for x in range(45) for y in range(x + 1, 45) if first(x) != first(y)}
