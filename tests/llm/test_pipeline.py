import random
import re

import corpus_pipeline
import public_tokenizers
import sentencepiece
from test_near_dedup import jp, shingles


def test_run_equals_brute_force(spark, tmp_path):
    r = random.Random(11)
    vocabulary = {lang: ["".join(r.choice(c) for _ in range(r.randrange(3, 8))) for _ in range(150)] for lang, c in (("aa", "abcdefgh"), ("bb", "qrstuvwx"))}
    rows, items = [], []
    for i in range(60):
        lang = ("aa", "bb")[i % 2]
        words = [r.choice(vocabulary[lang]) for _ in range(70)]
        rows.append((i, " ".join(words), lang, "s", 0))
    items = [(k, " ".join(r.choice(vocabulary["aa"]) for _ in range(25))) for k in range(3)]
    rows += [(60 + k, rows[k][1].replace(" ", "\n", 1), rows[k][2], "s", 0) for k in range(5)]  # copies
    rows += [(70 + k, rows[k][1].rsplit(" ", 1)[0] + " changed", rows[k][2], "s", 0) for k in range(5)]  # near copies
    rows += [(80 + k, rows[20 + k][1][:100] + " " + items[k][1] + " " + rows[24 + k][1][:90], "aa", "s", 0) for k in range(3)]  # leaks
    rows += [(90, "12 34 !!", None, "s", 0), (91, None, "aa", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept, seen = [], set()
    for i, text, *_ in rows:
        norm = re.sub(r"\s+", " ", text or "")
        if not re.search(r"[^\W\d_]", norm) or norm in seen:
            continue
        seen.add(norm)
        kept.append((i, text))
    alone = []
    for i, text in kept:
        if all(jp(shingles(text), shingles(t)) < 0.8 for _, t in alone):
            alone.append((i, text))
    clean = [(i, t) for i, t in alone if not any(b in t for _, b in items)]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {x[0] for x in clean} == set(range(60))
    got = {x.doc_id: x.ids for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: library.encode(t) for i, t in clean}


def test_stages_keep_columns_and_stand_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, row string")
    spark.createDataFrame([(1, "some item text")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.tokens(spark, docs, str(tmp_path)).count() == 0
