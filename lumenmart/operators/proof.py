"""What can be claimed of a result because the rows below it reproduce it: the measure behind it, slicers and cuts to add, row grain, trends.

A claim is made only where the numbers agree; where they don't, the answer is None or no row.
"""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenmart.operators.semantic import rank_dimensions, start_grain
from lumenmart.plans.names import find
from lumenmart.plans.trees import Plan

#: Difference of a cell, and of a total (absolute, relative); values of a slicer and of a cut; importance that a cut needs.
CELL, TOTAL, TOTAL_SHARE = 0.01, 2.0, 0.01
SLICER_VALUES, CUT_VALUES, IMPORTANT = 12, 12, 0.05


def within_scope(rows: DataFrame, scope: Mapping[str, object]) -> DataFrame:
    """Rows in a scope: a value, a list, or bounds (from, to, gt, lt) for each column."""
    for column, wanted in scope.items():
        x = F.col(column)
        if isinstance(wanted, Mapping):
            tests = {"from": x >= F.lit(wanted.get("from")), "to": x <= F.lit(wanted.get("to")), "gt": x > F.lit(wanted.get("gt")), "lt": x < F.lit(wanted.get("lt"))}
            for k in wanted:
                rows = rows.filter(tests[k])
        else:
            rows = rows.filter(x.isin(list(wanted)) if isinstance(wanted, (list, tuple, set)) else x == F.lit(wanted))
    return rows


def fixed_scope(gold: DataFrame, rows: DataFrame, measure: str) -> dict[str, object]:
    """Columns of a result that hold one value and are columns of the rows too: what the result is limited to."""
    shared = [c for c in gold.columns if c != measure and find(c, rows.columns)]
    if not shared:
        return {}
    out = gold.agg(*[x for k, c in enumerate(shared) for x in (F.count_distinct(c).alias(f"n{k}"), F.min(c).alias(f"v{k}"))]).first()
    return {find(c, rows.columns): out[f"v{k}"] for k, c in enumerate(shared) if out[f"n{k}"] == 1}


def stated_scope(gold: DataFrame, columns: Sequence[str]) -> dict[str, object] | None:
    """What a result's own plan limits it to, as a scope over these columns: {} where nothing does, None where not all of it can be said so.

    Tests of one column are taken together: lists by what they share and what lies in the bounds, bounds by the tighter one."""
    tests = Plan(gold).conditions()
    if tests is None or any(find(c, columns) is None for c, _, _ in tests):
        return None
    lists: dict[str, list] = {}
    bounds: dict[str, dict] = {}
    for column, how, values in tests:
        c = find(column, columns)
        if how in ("=", "in"):
            lists[c] = [v for v in lists.get(c, values) if v in values]
        else:
            held, tighter = bounds.setdefault(c, {}), max if how in ("from", "gt") else min
            held[how] = tighter(values[0], held.get(how, values[0]))
    lies = {"from": operator.ge, "to": operator.le, "gt": operator.gt, "lt": operator.lt}
    for c, values in lists.items():
        inside = [v for v in dict.fromkeys(values) if all(lies[k](v, b) for k, b in bounds.get(c, {}).items())]
        bounds[c] = inside[0] if len(inside) == 1 else inside
    return bounds


def scoped_rows(gold: DataFrame, measure: str, by: str, rows: DataFrame, column: str) -> DataFrame | None:
    """The rows that a result was made of, by the scope that its plan states, so that they can be cut by any other column: only where they give its numbers."""
    scope = stated_scope(gold, rows.columns)
    if scope is None:
        return None
    inside = within_scope(rows, scope)
    return inside if matches(gold, measure, inside, column, [by]) else None


def matches(gold: DataFrame, measure: str, rows: DataFrame, column: str, by: Sequence[str]) -> bool:
    """Whether the sums of the rows' column are the result's, cell by cell. Cells that only the rows have don't count."""
    want = gold.groupBy(*[F.col(b).alias(f"_g{k}") for k, b in enumerate(by)]).agg(F.round(F.sum(measure), 2).alias("_want"))
    got = rows.groupBy(*[F.col(b).alias(f"_r{k}") for k, b in enumerate(by)]).agg(F.round(F.sum(column), 2).alias("_got"))
    same = F.lit(True)
    for k in range(len(by)):
        same &= F.col(f"_g{k}").eqNullSafe(F.col(f"_r{k}"))
    near = F.abs(F.col("_got") - F.col("_want")) <= CELL + 1e-9
    return not want.isEmpty() and want.join(got, same, "left").filter(~F.coalesce(near, F.lit(False)) & F.col("_want").isNotNull()).isEmpty()


def measure_behind(gold: DataFrame, measure: str, cuts: Sequence[str], rows: DataFrame, candidates: Sequence[str]) -> tuple[str | None, dict[str, object]]:
    """The column whose sums, within the result's scope, are the result at its first cut that varies; and that scope: what its plan states and its values show."""
    scope = (stated_scope(gold, rows.columns) or {}) | fixed_scope(gold, rows, measure)
    lead = next((c for c in (find(c, rows.columns) for c in cuts) if c and c not in scope), None)
    if lead is None:
        return None, scope
    inside = within_scope(rows, scope)
    return next((c for c in candidates if matches(gold.withColumnRenamed(find(lead, gold.columns), lead), measure, inside, c, [lead])), None), scope


def suggestions(gold: DataFrame, measure: str, cuts: Sequence[str], rows: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """kind, column, detail: columns to slice by, as the result is fixed to one of several values; and the cut that explains most, where the result is reproduced."""
    source, scope = measure_behind(gold, measure, cuts, rows, candidates)
    texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType) and not f.name.lower().endswith("id")]
    counts = rows.agg(*[F.count_distinct(c).alias(c) for c in texts]).first().asDict() if texts else {}
    out = [("parameterize_scope", c, f"{counts[c]} values") for c in scope if c in texts and 2 <= counts[c] <= SLICER_VALUES]
    if source:
        others = [c for c in texts if c not in scope and c not in {find(x, rows.columns) for x in cuts} and 2 <= counts[c] <= CUT_VALUES]
        best = rank_dimensions(within_scope(rows, scope), others, source).limit(1).collect()  # one row
        out += [("add_cut", r["dimension"], f"{r['score']:.2f}") for r in best if r["score"] >= IMPORTANT]
    return rows.sparkSession.createDataFrame(out, "kind string, column string, detail string")


def rooted(gold: DataFrame, measure: str, by: str, rows: DataFrame, column: str, scope: Mapping[str, object]) -> DataFrame | None:
    """The result's chart on the rows themselves, so that it can be filtered by any of their columns: only where that gives the same numbers."""
    inside = within_scope(rows, scope)
    if not matches(gold, measure, inside, column, [by]):
        return None
    return inside.groupBy(by).agg(F.round(F.sum(column), 2).alias(measure))


def trend(gold_total: float, rows: DataFrame, measures: Mapping[str, tuple[str, str]], grains: Sequence[str]) -> tuple[str, str, DataFrame] | None:
    """A number's course in time: (measure, grain, rows) of the first measure (function, column) whose total over all rows is the number."""
    functions = {"sum": F.sum, "count": F.count, "count_distinct": F.count_distinct}
    totals = rows.agg(*[functions[f](c).cast("double").alias(n) for n, (f, c) in measures.items()]).first()
    near = [n for n in measures if totals[n] is not None and abs(totals[n] - gold_total) <= max(TOTAL, TOTAL_SHARE * abs(gold_total))]
    start, _ = start_grain(rows, grains)
    if not near or start is None or not gold_total:
        return None
    function, column = measures[near[0]]
    return near[0], start, rows.groupBy(start).agg(functions[function](column).alias(near[0]))


def classify_columns(frame: DataFrame) -> dict[str, str]:
    """date, measure or dimension of each column: by type, then by values; text that reads as a date in every row is one, and a column without values is a dimension."""
    texts = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.StringType)]
    dated = {}
    if texts:
        good = lambda c: F.count_if(F.try_to_date(F.substring(c, 1, 10)).isNotNull() | F.col(c).isNull())
        row = frame.agg(F.count(F.lit(1)).alias("_n"), *[x for k, c in enumerate(texts) for x in (good(c).alias(f"g{k}"), F.count(c).alias(f"c{k}"))]).first()
        dated = {c: row[f"g{k}"] == row["_n"] and row[f"c{k}"] > 0 for k, c in enumerate(texts)}
    out = {}
    for f in frame.schema.fields:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) or dated.get(f.name):
            out[f.name] = "date"
        elif isinstance(f.dataType, T.NumericType):
            out[f.name] = "date" if f.name.lower() in ("year", "month", "quarter", "week", "day") else "measure"
        else:
            out[f.name] = "dimension"
    return out
