"""The semantic model over a star: which table is the fact, which columns are measures, live aggregation, panels, drills and the grid.

A model is a joined frame with named measures. Whatever is asked of it is a filter, one grouping and an order over the grouped rows.
What is ranked or capped has been grouped before.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenmart.operators import profiling
from lumenmart.operators.kpi import Ambiguous, others, roll_up, slicer
from lumenmart.operators.verify import settled
from lumenmart.plans.names import find, label, sensitive

#: What names of measures, and of columns that are none, hold.
MEASURE_WORDS = ("amount", "price", "cost", "revenue", "total", "paid", "charge", "balance", "quantity", "qty", "sales", "value", "fee", "tax", "discount")
ID_NAME = r"(?i)(^|_)(id|key|code)$|(Id|ID|Key|key)$"
#: Rows of a grid's block, of a preview, categories and series of a chart, bars of a ranking, slices of a ring.
BLOCK, PREVIEW, CATEGORIES, SERIES, RANKED, SLICES = 1000, 5000, 12, 6, 12, 8
LADDER = ("year", "quarter", "month", "day")
ADDING = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


@dataclass(frozen=True)
class Live:
    """A measure that is aggregated when asked for: sum, count or count_distinct."""

    function: str
    column: str = "*"

    def value(self) -> Column:
        if self.function == "count":
            return F.count(F.lit(1))
        return F.count_distinct(self.column) if self.function == "count_distinct" else F.sum(self.column)


@dataclass(frozen=True)
class Model:
    frame: DataFrame
    measures: Mapping[str, Live] = field(default_factory=dict)


def infer_fact(edges: Sequence[tuple[str, str]], tables: Sequence[str]) -> str:
    """Of edges (many side, one side) the table that is most often the many side; the first of them, and of tables without edges, wins a tie."""
    counts = Counter(many for many, _ in edges)
    return max(counts, key=counts.get) if counts else tables[0]


def infer_measures(frame: DataFrame, columns: Sequence[str]) -> dict[str, Live]:
    """Sums of numeric columns whose names speak of amounts and that are no keys, and the number of records."""
    numeric = {f.name for f in frame.schema.fields if isinstance(f.dataType, T.NumericType)}
    named = [c for c in columns if c in numeric and not re.search(ID_NAME, c) and any(w in c.lower() for w in MEASURE_WORDS)]
    return {f"Total {label(c)}": Live("sum", c) for c in named} | {"Record Count": Live("count")}


def live(model: Model, name: str, by: Sequence[str] = (), filters: dict | None = None) -> DataFrame:
    """A measure of the model at any grain; column names are found whatever their case."""
    frame = slicer(model.frame, {find(k, model.frame.columns): v for k, v in (filters or {}).items() if find(k, model.frame.columns)})
    keys = [k for k in (find(b, frame.columns) for b in by) if k]
    return frame.groupBy(*keys).agg(model.measures[name].value().alias(name))


# Measures that were aggregated before
def classify(function: str, shape: str = "", metric: str = "") -> tuple[str, bool]:
    """(share | ratio | sum, whether it adds up). A share in which each entity counts once adds up; a ratio or average does not."""
    if shape.lower() == "percent" or re.search(r"percent|share|%", metric.lower()):
        return "share", True
    if function.lower() in ("avg", "mean") or re.search(r"\brat(io|e)\b|average|/", metric.lower()):
        return "ratio", False
    return "sum", True


def headline_function(function: str, shape: str = "", metric: str = "") -> str:
    """How a measure's grouped rows become one number: the largest share, the mean of averages and medians, the least, the greatest, or the sum."""
    if classify("sum", shape, metric)[0] == "share":
        return "max"
    return {"avg": "avg", "mean": "avg", "median": "avg", "min": "min", "max": "max"}.get(function.lower(), "sum")


def headline(frame: DataFrame, measure: str, kind: str = "number", entity: str | None = None, function: str = "sum") -> DataFrame:
    """One row, `headline`: of a ranking the leader and its value, of a share the number of segments, else the measure as one number."""
    if kind == "ranking":
        top = frame.agg(F.max_by(F.col(entity).cast("string"), F.struct(measure, entity)).alias("who"), F.max(measure).alias("v"))
        return top.select(F.concat_ws(": ", "who", F.format_string("%.2f", F.col("v").cast("double"))).alias("headline"))
    if kind == "share":
        return frame.agg(F.count_distinct(entity).cast("string").alias("headline"))
    return frame.agg(F.format_string("%.2f", ADDING[function](measure).cast("double")).alias("headline"))


def again(frame: DataFrame, measure: str, by: Sequence[str], function: str = "sum", as_percent: bool = False) -> DataFrame:
    """Grouped rows grouped again for display, with the function that the measure allows; as percent of their total where asked."""
    out = frame.groupBy(*by).agg(F.coalesce(ADDING[function](measure), F.lit(0)).alias(measure))
    if not as_percent:
        return out
    whole = out.agg(F.sum(measure).alias("_whole"))  # one row
    share = F.coalesce(F.try_divide(F.col(measure), F.nullif("_whole", F.lit(0))) * 100, measure)
    return out.join(F.broadcast(whole)).select(*by, share.alias(measure))


def capped(frame: DataFrame, category: str, series: str, measure: str, categories: int = CATEGORIES, kinds: int = SERIES) -> DataFrame:
    """The categories and series with the largest totals, each by its own; the rest of either is Other, added up again."""
    cells = frame.groupBy(category, series).agg(F.sum(measure).alias(measure))
    for column, k in ((category, categories), (series, kinds)):
        top = cells.groupBy(column).agg(F.sum(measure).alias("_t")).orderBy(F.desc("_t"), column).limit(k).select(F.col(column).alias("_top"))
        cells = others(cells, column, top)
    return cells.groupBy(category, series).agg(F.round(F.sum(measure), 2).alias(measure))


def in_order(frame: DataFrame, category: str, measure: str) -> DataFrame:
    """Adds `place`: by the number that all categories begin with, else by the measure, largest first. One row a category."""
    number = F.regexp_extract(F.col(category).cast("string"), r"^\s*(-?\d+(?:\.\d+)?)", 1)
    ordinal = frame.agg(F.bool_and(F.coalesce(number != "", F.lit(False))).alias("_ordinal"))  # one row
    by = F.when(F.col("_ordinal"), F.try_to_number(number, F.lit("S9999999999.99")).cast("double")).otherwise(-F.col(measure))
    marked = frame.join(F.broadcast(ordinal)).withColumn("_by", by)
    return marked.withColumn("place", F.row_number().over(Window.orderBy("_by", category))).drop("_ordinal", "_by")


def preview(frame: DataFrame, rows: int = PREVIEW) -> DataFrame:
    """The first rows that come: a look at a result, no order implied."""
    return frame.limit(rows)


# Panels and drills
def panel(frame: DataFrame, measure: str, additive: bool, by: Sequence[str], filters: dict | None = None, top: int | None = None) -> DataFrame:
    """Filtered, grouped, and the largest of it; nulls come last."""
    out = roll_up(frame, measure, list(by), additive, filters)
    return out.orderBy(F.desc_nulls_last(measure), *by).limit(top) if top else out


def cross_filter(frames: Mapping[str, DataFrame], filters: dict) -> dict[str, DataFrame]:
    """Each filter reaches every frame that has its column: any of the values within a column, all columns together, compared as text."""
    out = {}
    for name, frame in frames.items():
        for column, wanted in filters.items():
            if (at := find(column, frame.columns)) and wanted not in (None, [], ""):
                values = wanted if isinstance(wanted, (list, tuple, set)) else [wanted]
                frame = frame.filter(F.col(at).cast("string").isin([str(v) for v in values]))
        out[name] = frame
    return out


def drill(gold: DataFrame, silver: DataFrame | None, measure: str, additive: bool, by: Sequence[str], filters: dict | None = None) -> DataFrame | None:
    """The measure at another grain: from the result where that has all columns, else from the rows below it; None where neither can say."""
    for frame in (gold, silver):
        if frame is None or not find(measure, frame.columns) or not all(find(b, frame.columns) for b in by):
            continue
        keys = [find(b, frame.columns) for b in by]
        known = {find(k, frame.columns): v for k, v in (filters or {}).items() if find(k, frame.columns)}
        try:
            return roll_up(frame, find(measure, frame.columns), keys, additive, known)
        except Ambiguous:
            return None
    return None


def start_grain(frame: DataFrame, grains: Sequence[str] = LADDER, least: int = 2, most: int = 40) -> tuple[str | None, list[str]]:
    """The grain that a drill starts with, and the finer ones to follow: the coarsest with `least` different values that has at most `most`; one aggregation."""
    counts = frame.agg(*[F.count_distinct(g).alias(g) for g in grains]).first().asDict()
    enough = [g for g in grains if counts[g] >= least]
    fit = [g for g in enough if counts[g] <= most]
    start = (fit or enough or [None])[0]
    return start, [g for g in grains[list(grains).index(start) + 1 :] if counts[g] > counts[start]] if start else []


def drill_panels(frame: DataFrame, dims: Sequence[str], chosen: str, value: object, measure: str) -> dict[str, tuple[str, DataFrame]]:
    """After a click on a value of one dimension: for each other dimension that still varies, a ring (few values) or a ranking, and its rows."""
    rows = slicer(frame, {chosen: value})
    others = [d for d in dims if d != chosen]
    counts = rows.agg(*[F.count_distinct(d).alias(d) for d in others]).first().asDict() if others else {}
    kinds = {d: "ring" if n <= SLICES else "ranking" for d, n in counts.items() if n > 1}
    return {d: (kind, panel(rows, measure, True, [d], top=RANKED if kind == "ranking" else None)) for d, kind in kinds.items()}


# What a dimension says
def column_stats(frame: DataFrame, dims: Sequence[str]) -> dict[str, tuple[int, int, int]]:
    """rows, nulls and different values (null is one) of each column, in one aggregation."""
    out = frame.agg(F.count(F.lit(1)).alias("_n"), *[x for k, d in enumerate(dims) for x in (F.count_if(F.col(d).isNull()).alias(f"_x{k}"), F.count_distinct(d).alias(f"_d{k}"))]).first()
    return {d: (out["_n"], out[f"_x{k}"], out[f"_d{k}"] + (out[f"_x{k}"] > 0)) for k, d in enumerate(dims)}


def rank_dimensions(frame: DataFrame, dims: Sequence[str], measure: str | None, share: bool = False, most: int = 50, ideal: int = 12) -> DataFrame:
    """dimension, score, largest first: explained variance (or concentration for shares and counts) x filled share x ideal / values beyond `ideal`.

    Each dimension is one grouping; constants and dimensions of more than `most` values are left out."""
    stats = column_stats(frame, dims)
    out = None
    for place, d in enumerate(dims):
        n, nulls, values = stats[d]
        if values <= 1 or values > most:
            continue
        y = F.col(measure) if measure else F.lit(1)
        if share or measure is None:
            groups = frame.groupBy(d).agg(F.sum(y).alias("s"))
            p = groups.filter("s > 0").select((F.col("s") / F.sum("s").over(Window.partitionBy())).alias("p"))
            base = p.agg((1 + F.try_divide(F.sum(F.col("p") * F.ln("p")), F.ln(F.count(F.lit(1))))).alias("base"))
        else:
            base = profiling.explained(frame, d, measure).select(F.col("share").alias("base"))
        scale = (1 - nulls / max(n, 1)) * min(1.0, ideal / values)
        one = base.select(F.lit(d).alias("dimension"), F.round(F.greatest(F.lit(0.0), F.coalesce("base", F.lit(0.0))) * scale, 4).alias("score"), F.lit(place).alias("place"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return frame.sparkSession.createDataFrame([], "dimension string, score double")
    return out.orderBy(F.desc("score"), "place").drop("place")


def spread(frame: DataFrame, dimension: str, measure: str) -> DataFrame:
    """One row: informativeness (deviation of the group totals over their mean) and log_scale (all totals positive, and the largest 50 times the least)."""
    totals = frame.groupBy(dimension).agg(F.sum(measure).alias("t"))
    varied = F.when((F.count("t") < 2) | (F.avg("t") == 0), 0.0).otherwise(F.stddev_pop("t") / F.abs(F.avg("t")))
    logs = (F.count("t") >= 2) & (F.min("t") > 0) & (F.max("t") >= 50 * F.min("t"))
    return totals.agg(F.round(varied, 6).alias("informativeness"), F.coalesce(logs, F.lit(False)).alias("log_scale"))


def display_names(frame: DataFrame, key: str, names: DataFrame, names_key: str, name: str) -> DataFrame:
    """key replaced by the name that a lookup gives it; keys without a name stay, as text."""
    found = names.groupBy(F.col(names_key).alias("_key")).agg(F.min(name).alias("_name"))
    rest = [c for c in frame.columns if c != key]
    return frame.join(found, F.col(key) == F.col("_key"), "left").select(F.coalesce("_name", F.col(key).cast("string")).alias(key), *rest)


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows with their place in an order, from 1, in column `name`: no task sorts all of them.

    Ranges of the order are numbered each by itself and begin where the ranges before them end. The order must be a full one, so that ties are
    split among ranges too. The rows are settled first: a range must hold the same rows when it is counted and when it is numbered."""
    ranges = settled(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))  # one row a range
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))
    placed = ranges.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(*order))).join(F.broadcast(before), "_range")
    return placed.withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def anonymous(frame: DataFrame, column: str, measure: str, noun: str) -> DataFrame:
    """Names replaced by `noun 1`, `noun 2` and so on, by the measure, largest first; equal names get equal labels. One row a name is ranked."""
    ranked = numbered(frame.groupBy(column).agg(F.sum(measure).alias("_t")), "_k", F.desc_nulls_last("_t"), F.asc_nulls_first(column))
    ranked = ranked.select(F.col(column).alias("_name"), F.concat(F.lit(f"{noun} "), F.col("_k")).alias("_label"))
    rest = [c for c in frame.columns if c != column]
    return frame.join(ranked, F.col(column).eqNullSafe(F.col("_name"))).select(F.col("_label").alias(column), *rest)


def in_dates(frame: DataFrame, column: str, first: str | None, last: str | None) -> DataFrame:
    """Rows whose text reads as a date from first to last; with either bound set, those that don't read as one go."""
    day = F.try_to_date(F.substring(F.col(column).cast("string"), 1, 10))
    bounds = [day >= F.lit(first).cast("date")] * bool(first) + [day <= F.lit(last).cast("date")] * bool(last)
    for b in bounds:
        frame = frame.filter(b)
    return frame


# The grid
#: A grid's numeric tests.
TESTS = {"equals": "=", "notEqual": "<>", "greaterThan": ">", "greaterThanOrEqual": ">=", "lessThan": "<", "lessThanOrEqual": "<="}


def visible(frame: DataFrame, hidden: Sequence[str] = ()) -> list[str]:
    """Columns that may be shown: neither sensitive by name nor named in hidden."""
    gone = {h.lower() for h in hidden}
    return [c for c in frame.columns if c.lower() not in gone and not sensitive(c)]


def _tests(frame: DataFrame, request: dict, allowed: Sequence[str]) -> DataFrame:
    numeric = {f.name for f in frame.schema.fields if isinstance(f.dataType, T.NumericType)}
    for column, test in (request.get("filterModel") or {}).items():
        wanted = test.get("filter")
        if column not in allowed or wanted is None:
            continue
        x, kind = F.col(column), test.get("type")
        if test.get("filterType") == "number" and column in numeric:
            if kind in TESTS and isinstance(wanted, (int, float)):
                frame = frame.filter({"=": x == wanted, "<>": x != wanted, ">": x > wanted, ">=": x >= wanted, "<": x < wanted, "<=": x <= wanted}[TESTS[kind]])
        elif kind == "equals":
            frame = frame.filter(x.cast("string") == str(wanted))
        else:  # the text itself is sought: it is no pattern
            frame = frame.filter(F.contains(F.lower(x.cast("string")), F.lit(str(wanted).lower())))
    return frame


def grid(frame: DataFrame, request: dict, hidden: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows of the block asked for, one row with the number of all rows). Columns that may not be shown, functions that are not known and values
    that are no numbers have no effect. With rowGroupCols, the first level that is not opened yet is grouped; with all of them opened come rows."""
    allowed = visible(frame, hidden)
    rows = _tests(frame, request, allowed)
    levels = [g if isinstance(g, str) else g.get("id") for g in request.get("rowGroupCols") or []]
    levels, opened = [g for g in levels if g in allowed], request.get("groupKeys") or []
    for column, value in zip(levels, opened, strict=False):
        rows = rows.filter(F.col(column).cast("string") == str(value))
    numeric = {f.name for f in frame.schema.fields if isinstance(f.dataType, T.NumericType)}
    if len(opened) < len(levels):
        level = levels[len(opened)]
        asked = {v["field"]: str(v.get("aggFunc") or "").lower() for v in request.get("valueCols") or [] if v.get("field") in allowed and v.get("field") != level}
        functions = {c: f if f in ADDING else "sum" if c in numeric else "count" for c, f in asked.items()}
        out = rows.groupBy(level).agg(F.count(F.lit(1)).alias("_rows"), *[ADDING[f](c).alias(c) for c, f in functions.items()]).drop("_rows")
        order = [level]
    else:
        out, order = rows.select(*allowed), []
    asked = [(s["colId"], s.get("sort")) for s in request.get("sortModel") or [] if s.get("colId") in out.columns and s.get("sort") in ("asc", "desc")]
    order = [F.desc(c) if way == "desc" else F.asc(c) for c, way in asked] + [c for c in order if c not in dict(asked)]
    start = max(0, int(request.get("startRow") or 0))
    size = max(0, min(BLOCK, int(request.get("endRow") or start + 100) - start))
    return (out.orderBy(*order) if order else out).offset(start).limit(size), out.agg(F.count(F.lit(1)).alias("rows"))


def page_after(frame: DataFrame, order: Sequence[tuple[str, str]], unique: Sequence[str], after: Mapping[str, object] | None = None, size: int = BLOCK) -> DataFrame:
    """The page that follows the row `after` (values of the columns of order and unique; None: the first page), nulls last either way.

    The order is made whole by the columns `unique`, so each row is on one page, ties included. The keys are a filter that the scan can use, and the page is the best `size`
    rows of each task: a deep page costs what the first one does."""
    ways = [*order, *((u, "asc") for u in unique if u not in dict(order))]
    rows = frame
    if after is not None:
        past, equal = F.lit(False), F.lit(True)
        for column, way in ways:
            x, value = F.col(column), after[column]
            if value is not None:  # null comes behind every value, and nothing behind null
                bound = F.lit(value).cast(frame.schema[column].dataType)
                past = past | (equal & (x.isNull() | ((x > bound) if way == "asc" else (x < bound))))
                equal = equal & (x == bound)
            else:
                equal = equal & x.isNull()
        rows = frame.filter(F.coalesce(past, F.lit(False)))
    return rows.orderBy(*[F.asc_nulls_last(c) if way == "asc" else F.desc_nulls_last(c) for c, way in ways]).limit(size)


# Different values that can be added up
def sketched(frame: DataFrame, by: Sequence[str], distinct: Sequence[str], sums: Sequence[str] = (), lg_k: int = 14) -> DataFrame:
    """A mart: by, sums, and for each column of `distinct` a sketch of its different values, so that it can be rolled up and drilled like a sum."""
    return frame.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums], *[F.hll_sketch_agg(c, lg_k).alias(f"{c}_sketch") for c in distinct])


def rolled(mart: DataFrame, by: Sequence[str], sums: Sequence[str] = (), filters: Mapping[str, object] | None = None) -> DataFrame:
    """A sketched mart at a coarser grain: sums add up, sketches unite. Counts have the relative standard error `sketch_error`."""
    chosen = slicer(mart, filters) if filters else mart
    named = [c for c in mart.columns if c.endswith("_sketch")]
    out = chosen.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums], *[F.hll_union_agg(c).alias(c) for c in named])
    return out.select(*by, *sums, *[F.hll_sketch_estimate(c).alias(f"distinct_{c.removesuffix('_sketch')}") for c in named])


def sketch_error(lg_k: int = 14) -> float:
    """Relative standard error of a count from united sketches."""
    return 1.04 / (1 << lg_k) ** 0.5
