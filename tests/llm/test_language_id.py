import zlib

from pyspark.sql import functions as F

from lumenmart.llm import language_id

WORDS = {"aa": "solari mento vira quelo", "bb": "thrund gorsk wexl brund", "cc": "niitu pääso küla mööda"}


def corpus(spark):
    rows = []
    for i in range(300):
        lang = ("aa", "bb", "cc")[i % 3]
        w = WORDS[lang].split()
        rows.append((i, " ".join(w[(i + k * k) % 4] for k in range(12)), lang, "s"))
    return rows


def test_accuracy_and_contract(spark):
    docs = spark.createDataFrame(corpus(spark), "doc_id long, text string, lang string, lang_pred string")
    rows = language_id.identify(docs).collect()
    truth = {r[0]: r[2] for r in corpus(spark)}
    assert len(rows) == 300 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows if r.held_out) >= 0.95 * sum(r.held_out for r in rows)


def test_labels_of_held_out_rows_and_of_the_predicted_row_play_no_part(spark):
    docs = spark.createDataFrame(corpus(spark), "doc_id long, text string, lang string, source string")
    out = language_id.held_out(F.col("doc_id"))
    wrong = docs.withColumn("lang", F.when(out, "zz").otherwise(F.col("lang")))
    as_set = lambda df: {tuple(r) for r in language_id.identify(df).collect()}
    assert as_set(docs) == as_set(wrong)


def test_backoff_and_edges(spark):
    docs = spark.createDataFrame(
        corpus(spark) + [(900, None, "aa", ""), (901, "123 !!", None, ""), (902, "solarivira mentomento", None, ""), (902, "solarivira mentomento", None, ""), (903, "x " * 200_000, "aa", "")],
        "doc_id long, text string, lang string, row string",
    )
    got = {}
    for r in language_id.identify(docs).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert got[900] == got[901] == [("und", 0.0)] and got[902][0][0] == "aa" and len(got[902]) == 2 and got[902][0] == got[902][1]
    assert got[903][0][0] in WORDS
    kept = language_id.keep_recognised(docs)
    assert kept.columns == docs.columns and {900, 901}.isdisjoint(r.doc_id for r in kept.collect())


def test_untrained_and_empty(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert language_id.identify(docs).first().lang_pred == "und"
    assert language_id.identify(docs.limit(0)).count() == 0


def test_a_rare_language_keeps_its_rows_and_words_within_the_bounds(spark):
    assert language_id.quota([5, 100, 1000], 105) == 50 and language_id.quota([5, 5], 4) == 2
    rows = corpus(spark) + [(1000 + i, "ketola isumi narvo", "dd", "s") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.train(docs, settings=language_id.Settings(train_rows=24, max_words=8, max_grams=40))
    assert model.langs == ["aa", "bb", "cc", "dd"]
    out = language_id.predict(docs, model, carry=[docs.lang]).groupBy("lang", "lang_pred").count().collect()
    assert sum(r["count"] for r in out if r.lang == r.lang_pred) == len(rows)


def test_scores_by_hand(spark):
    """Known words by their log frequency, unseen ones by the mean of their longest known n-grams, step by step."""
    import math
    from collections import Counter

    texts = {"aa": ["bora bora tane", "tane mil bora"], "bb": ["sker skol vin", "vin vin skara"]}
    rows = [(i, t, lang) for lang, ts in texts.items() for i, t in enumerate(ts)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counted = {lang: Counter(w for t in ts for w in t.split()) for lang, ts in texts.items()}
    half = language_id.Settings().smoothing

    def table(n):
        each = {lang: Counter() for lang in texts}
        for lang, words in counted.items():
            for w, c in words.items():
                for g in language_id.grams(w, n) if n else [w]:
                    each[lang][g] += c
        kinds = set().union(*each.values())
        return {g: [math.log(each[x][g] + half) - math.log(sum(each[x].values()) + half * len(kinds)) for x in ("aa", "bb")] for g in kinds}

    tables = {n: table(n) for n in (0, *language_id.LENGTHS)}

    def word(w):
        if w in tables[0]:
            return tables[0][w]
        for n in language_id.LENGTHS:
            if found := [tables[n][g] for g in language_id.grams(w, n) if g in tables[n]]:
                return [sum(x) / len(found) for x in zip(*found, strict=True)]
        return [0.0, 0.0]

    for text in ("bora vin", "skarl", "boravin tan", "zzz", "vin vin bora mila"):
        total = [sum(x) for x in zip(*map(word, text.split()), strict=True)]
        p = [math.exp(t - max(total)) for t in total]
        got = model.predict(text)
        assert got[0] == ("aa" if p[0] >= p[1] else "bb") and abs(got[1] - max(p) / sum(p)) < 1e-9, text


def test_a_tie_goes_to_the_first_language(spark):
    rows = [(1, "mil tane bora", "bb"), (2, "mil tane bora", "aa")]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict("bora mil nato") == ("aa", 0.5)


def test_training_takes_no_row_object_a_word_to_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(spark), "doc_id long, text string, lang string, source string")
    kind, sizes = type(docs), []
    inner = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: (out := inner(self), sizes.append(len(out)))[0])
    model = language_id.train(docs)
    assert len(model.rows[0]) > len(model.langs) == 3 >= max(sizes)
