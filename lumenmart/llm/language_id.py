"""Language identification by words first, with a back-off to shorter and shorter character n-grams.

Training counts words and character n-grams (lengths 1 to 5, words marked at both ends) for each language. A known word scores
its log frequency in each language. An unseen word scores the mean log frequency of its known n-grams of the greatest length
that has any; then of the next shorter length. The sums over the whole text, with equal priors, give the posterior.

The model is fitted on at most about `train_rows` labelled rows, drawn by a hash of their ids up to an equal quota for each
language (rare languages are taken whole), and holds at most `max_words` words and `max_grams` n-grams of each length (by their
rank within a language, so that each has its own); both bounds keep what is broadcast at a fixed size. Rarer
words are what the back-off is for. Prediction reads every whole text; batches are split by Spark, and workers
remember the scores of recent words in a table of bounded size.

Defined results: null texts and texts without letters are `und` with score 0; a text whose every word is foreign to all n-grams
gets the first language with score 1 / languages; ties go to the first language by name; without training rows everything is
`und`; repeated rows are predicted alike; an empty table gives an empty result; extra columns are ignored (`predict`) or
stay as they are (`keep_recognised`).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenmart.llm.common import kept

LETTERS = re.compile(r"[^\W\d_]+")
LENGTHS = (5, 4, 3, 2, 1)


@dataclass(frozen=True)
class Settings:
    train_rows: int = 20_000
    max_words: int = 60_000
    max_grams: int = 30_000
    smoothing: float = 0.5
    remembered: int = 200_000
    min_score: float = 0.5


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3: these rows are never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of (lang, n, gram) in a task, n = 0 for words; handed on whenever many have gathered."""

    def out(words: dict[str, Counter]) -> pd.DataFrame:
        rows = []
        for lang, counted in words.items():
            rows += [(lang, 0, w, c) for w, c in counted.items()]
            for n in LENGTHS:
                of = Counter()
                for w, c in counted.items():
                    for g in grams(w, n):
                        of[g] += c
                rows += [(lang, n, g, c) for g, c in of.items()]
        return pd.DataFrame(rows, columns=["lang", "n", "gram", "count"])

    words: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        if sum(map(len, words.values())) > 100_000:
            yield out(words)
            words = {}
    if words:
        yield out(words)


@dataclass
class Model:
    """langs; rows: for each n (0: words) the row of each gram in scores, its log frequencies by language."""

    langs: list[str]
    rows: dict[int, dict[str, int]]
    scores: np.ndarray
    remembered: int = 200_000

    def __post_init__(self):
        self.known, self.free = dict(self.rows.get(0, {})), len(self.scores)
        # Rows that no word has taken yet hold no memory.
        self.table = np.zeros((self.free + self.remembered, len(self.langs)))
        self.table[: self.free] = self.scores

    def _learn(self, words: list[str]) -> None:
        """Gives unseen words rows: the mean of their known n-grams of the greatest length that has any."""
        if self.free + len(words) > len(self.table):
            self.known, self.free = dict(self.rows[0]), len(self.scores)
            if self.free + len(words) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((len(words), len(self.langs)))])
        parts, starts, sizes, empty = [], [], [], []
        for k, w in enumerate(words):
            for n in LENGTHS:
                if found := [r for r in map(self.rows[n].get, grams(w, n)) if r is not None]:
                    starts.append(len(parts)), sizes.append(len(found))
                    parts += found
                    break
            else:
                empty.append(k)
            self.known[w] = self.free + k
        some = np.setdiff1d(np.arange(len(words)), empty)
        self.table[self.free : self.free + len(words)] = 0
        if parts:
            self.table[self.free + some] = np.add.reduceat(self.scores[parts], starts, axis=0) / np.array(sizes)[:, None]
        self.free += len(words)

    def predict(self, text: str | None) -> tuple[str, float]:
        counted = Counter(LETTERS.findall(text.lower())) if text else None
        if not counted or not self.langs:
            return "und", 0.0
        if unseen := [w for w in counted if w not in self.known]:
            self._learn(unseen)
            if any(w not in self.known for w in counted):  # the table was emptied
                self._learn([w for w in counted if w not in self.known])
        at = np.fromiter(map(self.known.__getitem__, counted), np.int64, len(counted))
        total = np.fromiter(counted.values(), float, len(counted)) @ self.table[at]
        p = np.exp(total - total.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def quota(sizes: list[int], rows: int) -> float:
    """The most that each language may give so that all together give `rows`."""
    left, count = rows, len(sizes)
    for n in sorted(sizes):
        if n * count > left:
            return left / count
        left, count = left - n, count - 1
    return float(max(sizes))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings | None = None) -> Model:
    """docs: the rows to learn from; those without text or label are left out."""
    s = settings or Settings()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if sum(sizes.values()) > s.train_rows:
        q = quota(list(sizes.values()), s.train_rows)
        shares = rows.sparkSession.createDataFrame([(k, int(q / n * 2.0**63)) for k, n in sizes.items() if n > q], f"lang {rows.schema['lang'].dataType.simpleString()}, share long")
        draw = F.shiftrightunsigned(F.xxhash64("id", F.lit("train")), 1)
        rows = rows.join(F.broadcast(shares), "lang", "left").filter(F.col("share").isNull() | (draw < F.col("share"))).select("id", "text", "lang")
    counts = kept(
        rows.select("lang", "text").mapInPandas(_count, "lang string, n int, gram string, count long")
        .groupBy("n", "gram", "lang").agg(F.sum("count").alias("count"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("n", "lang").orderBy(F.desc("count"), "gram")))
        .groupBy("n", "gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "count"))).alias("by"), F.sum("count").alias("all"), F.min("rank").alias("rank")),
        "counts",
    )
    # As Arrow columns: a row object and a dict for each word or n-gram would take several times their memory on the driver.
    found = {n: counts.filter(F.col("n") == n).orderBy("rank", F.desc("all"), "gram").limit(s.max_grams if n else s.max_words).select("gram", F.map_keys("by").alias("lang"), F.map_values("by").alias("count")).toArrow().combine_chunks() for n in (0, *LENGTHS)}
    langs = sorted(pc.unique(pc.list_flatten(found[0]["lang"])).to_pylist())
    index, scores, at = {}, [np.zeros((0, len(langs)))], 0
    for n, top in found.items():
        counted = np.zeros((len(top), len(langs)))
        of, by = (pc.list_parent_indices(top["lang"]).to_numpy() if len(top) else np.empty(0, int)), pc.index_in(pc.list_flatten(top["lang"]), pa.array(langs, pa.string()))
        some = pc.is_valid(by).to_numpy()
        counted[of[some], by.to_numpy()[some].astype(int)] = pc.list_flatten(top["count"]).to_numpy()[some]
        scores.append(np.log(counted + s.smoothing) - np.log(counted.sum(axis=0) + s.smoothing * max(1, len(top))))
        index[n] = dict(zip(top["gram"].to_pylist(), range(at, at + len(top)), strict=True))
        at += len(top)
    return Model(langs, index, np.concatenate(scores), s.remembered)


def predict(docs: DataFrame, model: Model, text_col: str = "text", carry: list[Column] | None = None) -> DataFrame:
    """The columns `carry` (none may be called lang_pred or score) with lang_pred and score, a row for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.rows, model.scores, model.remembered))
    narrow = docs.select(*(carry or []), docs[text_col].alias("_lm_text"))
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in narrow.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for b in batches:
            got = [own.predict(t.as_py()) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score"]
            )

    return narrow.mapInArrow(run, f"{schema}{', ' if schema else ''}lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from the labelled rows that are not held out, predicted for all rows."""
    model = train(docs.filter(~held_out(docs[id_col])), id_col, text_col, lang_col, settings)
    return predict(docs, model, text_col, [docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out")])


def keep_recognised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings | None = None) -> DataFrame:
    """The rows of docs whose language is told with a score of at least `min_score`, with all their columns."""
    s = settings or Settings()
    model = train(docs.filter(~held_out(docs[id_col])), id_col, text_col, lang_col, s)
    told = predict(docs, model, text_col, [F.struct(*[docs[c] for c in docs.columns]).alias("row")])
    return told.filter((F.col("lang_pred") != "und") & (F.col("score") >= s.min_score)).select("row.*")
