"""Graphs of evidence and what is asked of them: terms, impact, groups that share keys, texts that answer, and decisions on what is known."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenmart.operators.graphs import components
from lumenmart.operators.verify import walk


def about(nodes: DataFrame, edges: DataFrame, term: str) -> DataFrame:
    """id, kind, relation of the nodes whose names hold the term (relation: itself) and of their neighbours either way."""
    found = nodes.filter(F.contains(F.lower("name"), F.lit(term.lower()))).select("id")
    out = edges.join(found, edges["source"] == found["id"], "left_semi").select(F.col("target").alias("id"), "relation")
    into = edges.join(found, edges["target"] == found["id"], "left_semi").select(F.col("source").alias("id"), "relation")
    near = found.withColumn("relation", F.lit("itself")).unionByName(out).unionByName(into).distinct()
    return near.join(nodes.select("id", "kind"), "id").select("id", "kind", "relation")


def impact(edges: DataFrame, start: str) -> DataFrame:
    """name, distance: all that depends on `start`, edges walked forward."""
    return walk(edges, start, "source", "target")


def sharing_groups(items: DataFrame, item: str, key: str) -> DataFrame:
    """item, root: items that share a key, directly or through others, have one root, the least of them. An item is tied to the least one of each of its keys, so
    no pairs of items are made."""
    links = items.select(F.col(item).alias("item"), F.col(key).alias("key")).dropna().distinct()
    least = links.groupBy("key").agg(F.min("item").alias("least"))
    return components(links.join(least, "key").select("item", "least"), "item", "least").select(F.col("node").alias(item), "root")


def retrieve(texts: DataFrame, path: str, title: str, body: str, query: str, top: int = 5, most: int = 400) -> DataFrame:
    """path, score, excerpt of the texts with most of the query's words: one for each in the body and one more for each in the title; ties by path."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: F.length(w) > 2))
    asked = words(F.lit(query))
    score = F.size(F.array_intersect(words(F.concat_ws(" ", title, body)), asked)) + F.size(F.array_intersect(words(F.col(title)), asked))
    scored = texts.select(F.col(path).alias("path"), score.alias("score"), F.substring(F.col(body), 1, most).alias("excerpt")).filter("score > 0")
    return scored.orderBy(F.desc("score"), "path").limit(top)


# Decisions
def holds(condition: Mapping, facts: Mapping[str, object]) -> tuple[bool | None, list[str]]:
    """(True, False or None, names of facts that lack). A fact that is not known leaves the answer open unless another part settles it.

    A condition has a test for each fact (a value, or {eq, ne, lt, lte, gt, gte, in, not_in, contains}); any_of has several conditions."""
    tests = {
        "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b,
        "in": lambda a, b: a in (b or []), "not_in": lambda a, b: a not in (b or []), "contains": lambda a, b: b in (a or []),
    }
    open_, answers = [], []
    for name, test in condition.items():
        if name == "any_of":
            parts = [holds(c, facts) for c in test]
            answers.append(True if any(a is True for a, _ in parts) else False if parts and all(a is False for a, _ in parts) else None)
            open_ += [n for _, lacking in parts for n in lacking] if answers[-1] is None else []
        elif name not in facts:
            answers.append(None)
            open_.append(name)
        else:
            each = test if isinstance(test, Mapping) else {"eq": test}
            answers.append(all(tests[op](facts[name], wanted) for op, wanted in each.items()))
    if False in answers:
        return False, []
    return (None, sorted(set(open_))) if None in answers else (True, [])


def decide(rules: list[tuple[str, Mapping]], facts: Mapping[str, object]) -> tuple[str | None, list[str]]:
    """The first rule whose condition holds; if one before it is open, no rule, and the facts that it lacks."""
    for outcome, condition in rules:
        answer, lacking = holds(condition, facts)
        if answer or answer is None:
            return (outcome, []) if answer else (None, lacking)
    return None, []
