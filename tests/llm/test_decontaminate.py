import random

from lumenmart.llm import decontaminate


def by_hand(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_longest_common_subsequence():
    import numpy as np

    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randrange(1, 40))] for _ in range(2))
        assert decontaminate.lcs(np.array(a), np.array(b)) == by_hand(a, b)


def corpus():
    r = random.Random(4)
    common, rare = ["the", "of", "and", "to", "in"], [f"term{k}" for k in range(900)]

    def prose(n):
        return [r.choice(common) if r.random() < 0.5 else r.choice(rare) for _ in range(n)]

    items = [(k, prose(r.choice([14, 30, 55, 120]))) for k in range(12)]
    rows, truth, loose = [], set(), set()
    for d in range(120):
        words = prose(r.choice([5, 80, 300]))
        if d % 6 == 0:
            k, item = items[d // 6 % 12]
            at = r.randrange(len(words) + 1)
            words[at:at] = item
            truth.add((d, k))
        elif d % 6 == 1:  # a paraphrase: some words replaced
            k, item = items[d // 6 % 12]
            said = [r.choice(common) if i % 9 == 4 else w for i, w in enumerate(item)]
            words[2:2] = said
            loose.add((d, k))
        rows.append((d, " ".join(words).replace(" of ", ", of. "), "c"))
    return rows, [(k, " ".join(w).title()) for k, w in items], truth, loose


def test_leaks_and_paraphrases_are_found_and_nothing_else(spark):
    rows, items, truth, loose = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, content string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert truth <= got and got <= truth | loose and len(got & loose) >= 0.9 * len(loose)
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {d for d, _ in got}


def test_edges(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, None), (2, ""), (None, item), (3, "x " * 100_000 + item), (3, "x " * 100_000 + item), (4, "!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, item), (9, None), (10, "")], "item_id long, text string")
    got = sorted(((r.doc_id or 0), r.item_id) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(0, 7), (0, 8), (3, 7), (3, 7), (3, 8), (3, 8)]
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [1, 2, 4]


def by_rule(words, item, telling, s):
    """The acceptance rule over every window."""
    n, size = len(item), s.block * s.blocks
    for begin in range(0, len(words), s.block):
        passage = words[max(0, begin - n) : begin + size + n]
        share, answer = by_hand(item, passage) / n, sum(t in passage for t in telling) / len(telling)
        if share >= s.verbatim or share >= s.paraphrase and answer >= s.answer:
            return True
    return False


def test_all_pairs_that_the_rule_takes_are_found(spark):
    """More items than the rank, and documents whose ordinary text hides the item from the latent space."""
    r = random.Random(6)
    rare = [f"term{k}" for k in range(3000)]
    s = decontaminate.Settings()
    items = [(k, [r.choice(rare) for _ in range(r.randrange(15, 60))]) for k in range(s.rank + 40)]
    rows = []
    for d in range(150):
        words, item = [r.choice(rare) for _ in range(90)], list(items[d][1])
        for at in r.sample(range(len(item)), len(item) * (d % 3) * 18 // 100):
            item[at] = r.choice(rare)
        for _ in range(len(item) // 3 * (d % 2)):
            item.insert(r.randrange(len(item)), r.choice(rare))
        words[40:40] = item
        rows.append((d, words))
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    b = decontaminate.read_benchmark(bench, "item_id", "text")
    renamed = docs.select(docs.doc_id.alias("id"), docs.doc_id.alias("content"), "text")
    hits = decontaminate.kept(decontaminate.positions(renamed, b.terms), "positions")
    space = decontaminate.fit(hits, b, s)
    name = {t: w for _, words in items for w, t in zip(words, b.items[b.ids.index(_)].tolist(), strict=True)}
    want = set()
    for k, item in items:
        telling = {name[t] for t in space.telling[b.ids.index(k)].tolist()}
        want |= {(d, k) for d, words in rows if len(set(item) & set(words)) >= len(set(item)) / 3 and by_rule(words, item, telling, s)}
    assert len(want) > 100
    assert {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, bench).collect()} == want


def test_items_longer_than_a_passage(spark):
    """Verbatim, and with a tenth of the words replaced."""
    r = random.Random(8)
    rare = [f"term{k}" for k in range(6000)]
    items = [(n, r.sample(rare, n)) for n in (200, 400, 900, 2500)]
    rows = []
    for n, item in items:
        around = [r.choice(rare) for _ in range(300)]
        rows += [(n, around[:150] + item + around[150:]), (n + 1, around[:150] + [w if k % 10 else "other" for k, w in enumerate(item)] + around[150:]), (n + 2, around)]
        rows.append((n + 3, item[: n // 2] + around))
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(n + k, n) for n, _ in items for k in (0, 1)}


def test_short_items_and_more_terms_than_the_bound(spark):
    r = random.Random(9)
    rows = [(1, "we say hello world here"), (2, "hello there world"), (3, "so ha ha ha it goes"), (4, "ha ha"), (5, "xylophone"), (6, "none of it")]
    items = [(1, "Hello, world!"), (2, "ha ha ha"), (3, "xylophone")]
    for k in range(10, 50):
        item = " ".join(f"w{r.randrange(10_000)}" for _ in range(20))
        items.append((k, item))
        rows.append((k, "first " + item))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, bench, settings=decontaminate.Settings(max_terms=20)).collect())
    assert got == [(1, 1), (3, 2), (5, 3)] + [(k, k) for k in range(10, 50)]


def test_the_bound_on_terms_leaves_each_item_its_rarest(spark):
    items = [(k, " ".join(f"w{k}x{i}" for i in range(20))) for k in range(30)]
    bench = decontaminate.read_benchmark(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
    docs = spark.createDataFrame([i for i in items for _ in range(i[0] + 1)], "id long, text string").selectExpr("id", "id AS content", "text")
    s = decontaminate.Settings(max_terms=20)
    space = decontaminate.fit(decontaminate.kept(decontaminate.positions(docs, bench.terms), "positions"), bench, s)
    assert all((space.weight[item] > 0).sum() >= s.weighted for item in bench.items)
