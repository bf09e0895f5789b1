"""Join planning: which keys are unique, which references resolve, which table a question starts from, and the left joins of the star.

The checks are DataFrame jobs that return a row; the graph that they prove is a handful of edges and is walked by the driver.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: When a key counts as unique, a reference as proven; confidence by what is proven.
UNIQUE_FROM = 0.99
RESOLVED_FROM = 0.5
CONFIDENCE = {"unique and resolved": 0.7, "unique": 0.62, "neither": 0.45}
#: Weights of the base table's score.
WEIGHTS = {"coverage": 4.0, "grain": 1.0, "fan_out": -1.5, "fact_edge": 0.25, "references": 0.2, "profiled": 0.25}


class NoJoinPath(ValueError):
    pass


@dataclass(frozen=True)
class Edge:
    """many.column refers to one.key."""

    many: str
    column: str
    one: str
    key: str
    confidence: float = 0.7

    @property
    def executable(self) -> bool:
        return self.confidence >= CONFIDENCE["unique"]


def uniqueness(df: DataFrame, *keys: str) -> DataFrame:
    """For each key: distinct values / values that are there."""
    one = df.agg(*[F.round(F.count_distinct(k) / F.nullif(F.count(k), F.lit(0)), 6).alias(k) for k in keys])
    return one.unpivot([], list(keys), "key", "ratio")


def resolution(many: DataFrame, column: str, one: DataFrame, key: str) -> DataFrame:
    """Different values of column, those found among key, and their ratio: two distinct sets joined, one row back."""
    left = many.select(F.col(column).alias("l")).filter("l IS NOT NULL").distinct()
    right = one.select(F.col(key).alias("r")).filter("r IS NOT NULL").distinct()
    return left.join(right, F.col("l") == F.col("r"), "left").agg(
        F.count(F.lit(1)).alias("values"), F.count("r").alias("resolved"), F.round(F.try_divide(F.count("r"), F.count(F.lit(1))), 6).alias("ratio")
    )


def orphans(many: DataFrame, column: str, one: DataFrame, key: str) -> DataFrame:
    """Rows whose reference finds nothing."""
    return many.filter(F.col(column).isNotNull()).join(one.select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_anti")


def prove(many: str, left: DataFrame, column: str, one: str, right: DataFrame, key: str) -> Edge:
    """The edge with the confidence that the data give it."""
    unique = (uniqueness(right, key).first().ratio or 0) >= UNIQUE_FROM
    resolved = (resolution(left, column, right, key).first().ratio or 0) >= RESOLVED_FROM
    return Edge(many, column, one, key, CONFIDENCE["unique and resolved" if unique and resolved else "unique" if unique else "neither"])


def references(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """many, column_name, one, key, values, resolved, ratio, key_ratio: for every two of the columns named, how many of the first one's different values the second one has, and
    how unique the second one is.

    One pass: all columns become rows of (value, column), which are counted; grouped by value they give the set of columns that hold it; and the sets, which are few,
    are counted. Every containment and uniqueness follows from these counts. Whole numbers meet whole numbers and texts meet texts."""
    where = [(t, c) for t, cs in columns.items() for c in cs]
    if not where:
        raise ValueError("no columns")
    stacked = None
    for t, cs in columns.items():
        text = {c: isinstance(tables[t].schema[c].dataType, T.StringType) for c in cs}
        each = [F.struct(F.lit(where.index((t, c))).alias("c"), F.lit(text[c]).alias("text"), F.col(c).cast("string").alias("v")) for c in cs]
        one = tables[t].select(F.inline(F.array(*each))).filter("v IS NOT NULL")
        stacked = one if stacked is None else stacked.unionByName(one)
    counted = stacked.groupBy("text", "v", "c").agg(F.count(F.lit(1)).alias("n"))
    sets = counted.groupBy("text", "v").agg(F.array_sort(F.collect_list(F.struct("c", "n"))).alias("m"))  # at most a member a column
    # A set counts its values; its members their rows.
    by_set = sets.groupBy(F.transform("m", lambda x: x["c"]).alias("s")).agg(F.count(F.lit(1)).alias("values"), *[F.sum(F.coalesce(F.get(F.col("m"), F.lit(k))["n"], F.lit(0))).alias(f"_n{k}") for k in range(len(where))])
    ranked = by_set.select("s", "values", F.array(*[f"_n{k}" for k in range(len(where))]).alias("rows"))
    own = ranked.select(F.posexplode("s").alias("k", "c"), "values", "rows").groupBy("c").agg(F.sum("values").alias("values"), F.sum(F.get("rows", F.col("k"))).alias("rows"))
    both = ranked.select(F.explode("s").alias("a"), "s", "values").select("a", F.explode("s").alias("b"), "values").groupBy("a", "b").agg(F.sum("values").alias("resolved"))
    # From here on a row a column, and a row for each two of them.
    names = F.broadcast(tables[where[0][0]].sparkSession.createDataFrame([(k, t, c) for k, (t, c) in enumerate(where)], "c int, t string, name string"))
    left, right = names.select(F.col("c").alias("a"), F.col("t").alias("many"), F.col("name").alias("column_name")), names.select(F.col("c").alias("b"), F.col("t").alias("one"), F.col("name").alias("key"))
    pairs = left.join(right, F.col("a") != F.col("b"))
    out = pairs.join(own.select(F.col("c").alias("a"), "values"), "a", "left").join(own.select(F.col("c").alias("b"), F.round(F.col("values") / F.col("rows"), 6).alias("key_ratio")), "b", "left").join(both, ["a", "b"], "left")
    values, resolved = F.coalesce("values", F.lit(0)), F.coalesce("resolved", F.lit(0))
    return out.select("many", "column_name", "one", "key", values.alias("values"), resolved.alias("resolved"), F.round(F.try_divide(resolved, values), 6).alias("ratio"), "key_ratio")


def proven(found: DataFrame) -> list[Edge]:
    """The edges that `references` bear out, as `prove` finds them one by one, by confidence."""
    unique, resolved = F.coalesce(F.col("key_ratio") >= UNIQUE_FROM, F.lit(False)), F.coalesce(F.col("ratio") >= RESOLVED_FROM, F.lit(False))
    rows = found.filter(unique & resolved).collect()  # edges: at most a row for each two columns
    return [Edge(r.many, r.column_name, r.one, r.key, CONFIDENCE["unique and resolved"]) for r in sorted(rows, key=lambda r: (r.many, r.column_name, r.one, r.key))]


def candidate_keys(left: DataFrame, right: DataFrame, endings: tuple[str, ...] = ("key", "id", "code")) -> list[tuple[str, str]]:
    """Columns that share a name behind their table's prefix and end like a key."""
    bare = lambda c: c.split("_", 1)[-1].lower()
    kinds_l, kinds_r = dict(left.dtypes), dict(right.dtypes)
    whole = {"int", "bigint", "smallint", "string"}
    return [
        (a, b) for a in left.columns for b in right.columns if bare(a) == bare(b) and bare(a).endswith(endings) and kinds_l[a] in whole and (kinds_l[a] == "string") == (kinds_r[b] == "string")
    ]


def path(edges: list[Edge], start: str, goal: str) -> list[Edge] | None:
    """The shortest way from many to one."""
    waiting, came = deque([start]), {start: None}
    while waiting:
        at = waiting.popleft()
        if at == goal:
            out = []
            while came[at] is not None:
                out.append(came[at])
                at = came[at].many
            return out[::-1]
        for e in edges:
            if e.many == at and e.executable and e.one not in came:
                came[e.one] = e
                waiting.append(e.one)
    return None


def base_scores(edges: list[Edge], needed: dict[str, int], rows: dict[str, int], grain: set[str] = frozenset()) -> list[tuple[str, float]]:
    """Tables by how well a question could start there. needed: references by table; row counts only break ties."""
    tables = {t for e in edges for t in (e.many, e.one)} | set(needed)
    scored = []
    for t in tables:
        reached = [n for n in needed if n == t or path(edges, t, n)]
        fans = len([n for n in needed if n not in reached and path(edges, n, t)])
        score = WEIGHTS["coverage"] * len(reached) / max(1, len(needed)) + WEIGHTS["grain"] * (t in grain) + WEIGHTS["fan_out"] * fans
        score += WEIGHTS["fact_edge"] * min(2, sum(e.many == t for e in edges)) + WEIGHTS["references"] * min(5, needed.get(t, 0)) + WEIGHTS["profiled"] * (t in rows)
        scored.append((t, round(score, 4)))
    return sorted(scored, key=lambda s: (-s[1], -rows.get(s[0], 0), s[0]))


#: Scores nearer than this are a tie; bytes of a table that may be broadcast.
NEAR_TIE, SMALL = 0.35, 10 << 20


def choose_base(scores: list[tuple[str, float]], rows: dict[str, int], pinned: str | None = None) -> tuple[str, list[str]]:
    """(where to start, tables that would do as well). A pinned table wins; among near ties the one with most rows does."""
    if pinned is not None:
        if pinned not in dict(scores):
            raise NoJoinPath(f"{pinned} is none of the tables")
        return pinned, []
    best = max(s for _, s in scores)
    tied = sorted((t for t, s in scores if best - s < NEAR_TIE), key=lambda t: (-rows.get(t, 0), t))
    exact = sorted((t for t, s in scores if s == best), key=lambda t: (-rows.get(t, 0), t))
    return exact[0], [t for t in tied if t != exact[0]]


def edge_between(edges: list[Edge], left: str, right: str) -> tuple[Edge, bool] | None:
    """The executable edge of two tables, asked for either way round; and whether it is the other way."""
    for e in edges:
        if e.executable and {e.many, e.one} == {left, right}:
            return e, e.many == right
    return None


def formula_tables(formula: str, base: str, columns: dict[str, list[str]]) -> list[str]:
    """The other tables that a formula's bare columns need. Columns within EXISTS (...) or with their table's name before them ask for no join."""
    bare = re.sub(r"(?i)\bexists\s*\((?:[^()]|\([^()]*\))*\)", "", re.sub(r"'[^']*'", "", formula))
    named = set(re.findall(r"(?<![\w.])([A-Za-z_]\w*)(?!\s*[(.]|\w)", bare))
    return sorted(t for t, cs in columns.items() if t != base and named & set(cs) - set(columns[base]))


def fan_traps(edges: list[Edge]) -> list[tuple[str, str, str]]:
    """Dimensions that two tables refer to: joined through it, their rows multiply."""
    by_one: dict[str, set[str]] = {}
    for e in edges:
        if e.executable:
            by_one.setdefault(e.one, set()).add(e.many)
    return sorted((one, a, b) for one, many in by_one.items() for a in many for b in many if a < b)


def star(tables: dict[str, DataFrame], edges: list[Edge], base: str, needed: list[str], sizes: dict[str, int] | None = None) -> DataFrame:
    """base with the needed tables left-joined along proven edges, many to one, so that base's rows stay as many. Columns whose names clash get `<table>_` before.

    sizes: bytes of tables, where they are known; only tables known to be small are broadcast, the rest is left to adaptive execution."""
    out, have = tables[base], {base}
    for goal in needed:
        if goal in have:
            continue
        steps = path(edges, base, goal)
        if steps is None:
            raise NoJoinPath(f"no proven way from {base} to {goal}")
        for e in steps:
            if e.one in have:
                continue
            right = tables[e.one]
            for clash in set(right.columns) & set(out.columns):
                right = right.withColumnRenamed(clash, f"{e.one}_{clash}")
            key = e.key if e.key in right.columns else f"{e.one}_{e.key}"
            known_small = (sizes or {}).get(e.one, SMALL + 1) <= SMALL
            out = out.join(F.broadcast(right) if known_small else right, out[e.column] == right[key], "left")
            have.add(e.one)
    return out
