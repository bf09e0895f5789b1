"""Business metrics: what is asked (`Kpi`), how the common wordings read, and the DataFrame that answers it.

A metric is an aggregate over a frame that is joined already. Shares, running and moving values and ranks are computed over the
grouped rows, never over the raw ones, so the one large shuffle is that of the grouping, after partial aggregation. An exact median keeps the
different values of a group in one task; approx_median stands for it where groups are large.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenmart.functions import columns as c
from lumenmart.plans.names import resolve, resolve_group, safe_expr, words

#: Other names of the aggregates.
ALIASES = {"mean": "avg", "average": "avg", "std": "stddev", "var": "variance", "total": "sum", "number": "count"}
AGGREGATES = {
    "sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max, "median": lambda x: F.percentile(x, F.lit(0.5)), "stddev": F.stddev_samp, "variance": F.var_samp,
    "count_distinct": F.count_distinct, "approx_median": lambda x: F.percentile_approx(x, F.lit(0.5), F.lit(10_000)), "approx_count_distinct": F.approx_count_distinct,
}
ROUNDED = ("sum", "avg", "median", "stddev", "variance", "approx_median")
UNITS = ("year", "quarter", "month", "week", "day")
#: How prose asks for a grain, and for the largest.
GRAINS = {"yearly": "year", "annual": "year", "quarterly": "quarter", "monthly": "month", "weekly": "week", "daily": "day"}
UNIT = "(year|quarter|month|week|day)"
GRAIN = re.compile(rf"\b(?:each|per|every|by) {UNIT}\b|\b{UNIT} over (?:the )?(?:year|time)\b|\b({'|'.join(GRAINS)})\b")
#: What bounds are called.
BOUNDS = {
    "at least": ">=", "no less than": ">=", "no fewer than": ">=", "not less than": ">=", "a minimum of": ">=", "more than": ">", "over": ">", "above": ">", "older than": ">", "greater than": ">", "exceeding": ">",
    "at most": "<=", "no more than": "<=", "not more than": "<=", "up to": "<=", "a maximum of": "<=", "fewer than": "<", "less than": "<", "under": "<", "below": "<", "younger than": "<", ">=": ">=", "<=": "<=", ">": ">", "<": "<",
}
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
NUMBER = rf"(\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d+(?:\.\d+)?|(?:{'|'.join(NUMBERS)})\b)(?![\d%])"
#: The noun behind a number says what is bounded; these words begin another part of the sentence.
NOUN = r"(?: (?!(?:with|having|and|or|in|for|by|per|each|of|to|on|at|from)\b)([a-z_]+))?"
#: A bound in prose: of a measure after with or having or before a noun, of an age otherwise.
BOUND = re.compile(rf"(?:\b(with|having) )?(?<![\w<>=])({'|'.join(sorted(map(re.escape, BOUNDS), key=len, reverse=True))}) ?{NUMBER}{NOUN}")
BETWEEN = re.compile(rf"(?:\b(with|having) )?\bbetween {NUMBER} and {NUMBER}{NOUN}")
RANKED = re.compile(rf"\b(top|bottom)\b(?:[ -]{NUMBER})?")
PERIOD = re.compile(rf"\b(?:last|past|previous) (?:{NUMBER} )?(years?|quarters?|months?|weeks?|days?)\b")
#: Grains that are asked for and not known.
OTHER_GRAIN = re.compile(r"\b(?:each|per|every|by) (fortnight|decade|century|hour|minute|second|semester|half[- ]year|season)\b|\b(fortnightly|hourly|biweekly|biannual|half-yearly)\b")
EXTRA = (
    ("count", re.compile(r"(?:\band|\bwith|,) (?:the )?(?:number of times|number of them|how many times|times they were)\b()")),
    ("avg", re.compile(r"(?:\band|\bwith|,) (?:the )?(?:average|avg|mean) ([a-z][a-z0-9_ ]*?)(?: (?:for|per|of|each|by|and)\b|[.?]|$)")),
    ("sum", re.compile(r"(?:\band|\bwith|,) (?:the )?total ([a-z][a-z0-9_ ]*?)(?: (?:for|per|of|each|by|and)\b|[.?]|$)")),
)
MOST, FEWEST = ("most", "highest", "largest", "greatest", "maximum"), ("lowest", "smallest", "fewest")


class Ambiguous(ValueError):
    """The question can't be answered as it stands; the message says what to decide."""


@dataclass(frozen=True)
class Measure:
    """An aggregate; where: only rows that pass count."""

    function: str
    column: str = "*"
    where: str | None = None

    @property
    def name(self) -> str:
        return f"{self.function}_{re.sub(r'[^a-z0-9]+', '_', self.column.lower()).strip('_') or 'rows'}"

    @property
    def additive(self) -> bool:
        return self.function in ("sum", "count")

    def raw(self) -> Column:
        value = F.lit(1) if self.column == "*" else safe_expr(self.column)
        return AGGREGATES[self.function](F.when(safe_expr(self.where), value) if self.where else value)

    def shown(self, value: Column) -> Column:
        return F.round(value, 2) if self.function in ROUNDED else value


@dataclass(frozen=True)
class Dim:
    """A cut: a column, or a column by time unit, band width, age or days as of a date."""

    column: str
    kind: str = "column"
    by: object = None
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or {"column": self.column, "time": self.by, "band": f"{self.column}_band", "age": "age", "age_band": "age_band", "days": "days_since"}[self.kind]

    @property
    def continuous(self) -> bool:
        return self.kind in ("age", "days")

    def value(self) -> Column:
        x = F.col(self.column)
        if self.kind == "time":
            return c.time_bucket(self.by, x)
        if self.kind == "band":
            return c.band(x, self.by)
        if self.kind in ("age", "age_band"):
            age = c.age_calendar(x, F.lit(self.by).cast("date") if isinstance(self.by, str) and re.match(r"\d{4}-", self.by) else F.col(self.by))
            return c.age_band(age) if self.kind == "age_band" else age
        return c.days_since(x, F.lit(self.by).cast("date")) if self.kind == "days" else x


@dataclass(frozen=True)
class Kpi:
    """share: total, group (of the dims in `within`) or period; window: running, moving or rank; entity: each counts once, where it was last.

    having and also bound the first measure; top: so many rows, the largest (lowest: the smallest) first."""

    measures: tuple[Measure, ...]
    dims: tuple[Dim, ...] = ()
    filters: tuple[str, ...] = ()
    ratio: bool = False
    share: str | None = None
    within: tuple[str, ...] = ()
    window: str | None = None
    span: int = 3
    having: tuple[str, float] | None = None
    also: tuple[str, float] | None = None
    top: int | None = None
    lowest: bool = False
    entity: str | None = None
    latest: tuple[str, ...] = field(default=())


def _measure(text: str) -> Measure:
    m = re.fullmatch(r"\s*(\w+)\s*\(\s*(distinct\s+)?(.*?)\s*\)\s*", text, re.I)
    if not m:
        raise Ambiguous(f"no aggregate in {text!r}")
    function = ALIASES.get(m[1].lower(), m[1].lower())
    if m[2]:
        return Measure("count_distinct", m[3])
    test = re.fullmatch(r"(\w+)\s*(=|!=|<=|>=|<|>)\s*('[^']*'|[\d.]+)", m[3])
    if function == "count" and test:
        return Measure("count", "*", m[3])
    if function not in AGGREGATES:
        raise Ambiguous(f"unknown aggregate {m[1]!r}")
    return Measure(function, m[3] or "*")


def read_dim(text: str, as_of: str | None = None) -> Dim:
    """Month(d), Band(x, 10), Age(d), AgeBand(d), DaysSince(d) or a column."""
    m = re.fullmatch(r"\s*(\w+)\s*\(\s*(\w+)\s*(?:,\s*([\d.]+))?\s*\)\s*", text)
    if not m:
        return Dim(text.strip())
    kind, column = m[1].lower(), m[2]
    if kind in UNITS:
        return Dim(column, "time", kind)
    if kind == "band":
        return Dim(column, "band", float(m[3]) if "." in m[3] else int(m[3]))
    kinds = {"age": "age", "ageband": "age_band", "dayssince": "days"}
    if kind not in kinds or as_of is None:
        raise Ambiguous(f"{text!r} needs a known kind and an as-of date")
    return Dim(column, kinds[kind], as_of)


def _shape(text: str) -> Kpi:
    """What the metric computes. Wordings are tried in order; the first that fits decides."""
    if m := re.match(r"(?:percent(?:age)?|share)\s+of\s+(.*?)\s*/.*\bfor\s+(\w+)\s*$", text, re.I):  # of each cell in the whole, or in its group or period
        return Kpi((_measure(re.sub(r"(?i)^(total|group)\s+(of\s+)?", "", m[1])),), share="scope", within=(m[2],))
    if m := re.match(r"(?:percent(?:age)?|share)\s+of\s+(total|group)?\s*(.*)", text, re.I):
        return Kpi((_measure(re.sub(r"(?i)^of\s+", "", m[2]).split("/")[0]),), share=(m[1] or "total").lower())
    if m := re.match(r"rank of (.*?) within (\w+)", text, re.I):
        return Kpi((_measure(m[1]),), window="rank", within=(m[2],))
    if m := re.match(r"running total of (.*)", text, re.I):
        return Kpi((_measure(m[1]),), window="running")
    if m := re.match(r"(\d+)[- ](?:\w+ )?moving average of (.*)", text, re.I):
        return Kpi((_measure(m[2]),), window="moving", span=int(m[1]))
    if "/" in text:
        return Kpi(tuple(_measure(x) for x in text.split("/")), ratio=True)
    return Kpi(tuple(_measure(x) for x in re.split(r",(?![^()]*\))", text)))


def _references(column: str) -> set[str]:
    """What a question may call a column: its name, and the first letters of its words."""
    short = "".join(w[0] for w in words(column))
    return {column.lower()} | ({short} if len(short) > 1 else set())


def _quoted(text: object) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def _filters(question: str, cuts: str, dims: tuple[Dim, ...]) -> list[str]:
    """Filters that prose holds: "for Emea region" or its abbreviation, and short quoted values where a cut is named beside them."""
    out = []
    columns = [d for d in dims if d.kind == "column"]
    for d in columns:
        for ref in sorted(_references(d.column)):
            if m := re.search(rf"\b(?:for|in)\s+([A-Za-z]\w*)\s+{re.escape(ref)}\b", question, re.I):
                out.append(f"{d.column} = {_quoted(m[1].title())}")
                break
    for text in (cuts, question):
        if re.search(r"[<>=]", text):
            continue
        anchor = next((d for d in columns if d.name.lower() in text.lower()), None)
        for value in re.findall(r"['\"]([^'\"]{1,40})['\"]", text):
            if anchor and len(value.split()) <= 2 and not any(f.lower().endswith(_quoted(value.strip()).lower()) for f in out):
                out.append(f"{anchor.column} = {_quoted(value.strip())}")
    return out


def _extra(question: str, first: Measure, labels: dict[str, str]) -> list[Measure]:
    """A second measure that only the question asks for; its column must be known."""
    for function, pattern in EXTRA:
        if first.function != function and (m := pattern.search(question)):
            column = "*" if function == "count" else resolve(m[1].strip(), labels)
            if column:
                return [Measure(function, column)]
    return []


def _number(text: str) -> float:
    return float(NUMBERS.index(text) + 1) if text in NUMBERS else float(text.replace(",", ""))


def _bounds(question: str) -> list[tuple[str, bool, list[tuple[str, float]], str | None]]:
    """(phrase, whether with or having stands before it, tests, noun) of each bound in prose."""
    out = [(m[0], bool(m[1]), [(">=", _number(m[2])), ("<=", _number(m[3]))], m[4]) for m in BETWEEN.finditer(question)]
    return out + [(m[0], bool(m[1]), [(BOUNDS[m[2]], _number(m[3]))], m[4]) for m in BOUND.finditer(BETWEEN.sub(" ", question))]


def _periods(question: str, as_of: str | None, column: str | None) -> list[str]:
    """Filters for the last so many years, quarters, months, weeks or days up to a date that is given."""
    out = []
    for m in PERIOD.finditer(question):
        if m[1] is None or column is None or not re.match(r"\d{4}-\d\d-\d\d$", as_of or ""):
            raise Ambiguous(f"{m[0]!r} needs a number, a time column and a date that it ends at")
        n, unit = int(_number(m[1])), m[2].rstrip("s")
        months = {"year": 12, "quarter": 3, "month": 1}.get(unit)
        first = f"add_months(DATE '{as_of}', {-n * months})" if months else f"date_sub(DATE '{as_of}', {n * (7 if unit == 'week' else 1)})"
        out += [f"cast({column} AS date) > {first}", f"cast({column} AS date) <= DATE '{as_of}'"]
    return out


def _listed(text: str) -> str:
    """A list of values of a cut, each quoted unless it is a number."""
    m = re.match(r"(\w+)\s+(not\s+)?in\s*\((.*)\)$", text, re.I)
    values = [v.strip() for v in re.findall(r"'(?:[^']|'')*'|[^,]+", m[3]) if v.strip()]
    quoted = [v if v.startswith("'") or re.fullmatch(r"-?\d+(\.\d+)?", v) else _quoted(v) for v in values]
    return f"{m[1]} {'NOT ' if m[2] else ''}IN ({', '.join(quoted)})"


def read(
    metric: str, cuts: str = "", question: str = "", as_of: str | None = None, time_column: str | None = None, labels: dict[str, str] | None = None, denominator: str | None = None,
) -> Kpi:
    """The metric, cuts and question as a Kpi.

    labels: columns by what they are called, for measures that only prose names. denominator: grand_total, within_group or within_period overrules what
    a share is of. A threshold or grain that can't be placed is an error, never dropped."""
    kpi, said = _shape(metric.strip()), f"{metric} {question}".lower()
    tokens = [x.strip() for x in re.split(r",(?![^()]*\))", cuts) if x.strip()]
    compared = [t for t in tokens if re.match(r"\w+\s*(<=|>=|!=|=|<|>)\s*('[^']*'|[\w.]+)$", t)]
    lists = [t for t in tokens if re.match(r"\w+\s+(not\s+)?in\s*\(.*\)$", t, re.I)]
    rest = [t for t in tokens if t not in compared and t not in lists]
    dims = tuple(read_dim(x, as_of) for x in rest if not re.fullmatch(r"'.*'", x))
    if (m := GRAIN.search(said)) and not any(d.kind == "time" for d in dims):
        unit = next(g for g in m.groups() if g)
        if time_column is None:
            raise Ambiguous(f"{m[0]!r} needs a time column")
        dims = (Dim(time_column, "time", GRAINS.get(unit, unit)), *dims)
    filters = [f for t in compared for f in (re.sub(r"(=|<|>)\s*([A-Za-z_]\w*)$", lambda v: f"{v[1]} {_quoted(v[2])}", t),)] + [_listed(t) for t in lists] + _filters(question, ", ".join(rest), dims)
    bounds, ages = [], next((d for d in dims if d.kind == "age"), None)
    for phrase, with_, tests, noun in _bounds(question.lower()):
        of_age = "older" in phrase or "younger" in phrase or (not with_ and (noun is None or noun.startswith("year")))
        if of_age and ages:
            filters += [f"year({_as_of(ages)}) - year({ages.column}) {op} {n:g}" for op, n in tests]
        elif of_age:
            raise Ambiguous(f"{phrase!r}: a bound of what?")
        else:
            bounds += tests
    if len(bounds) > 2:
        raise Ambiguous(f"{len(bounds)} bounds of one measure")
    having, also = [*bounds, None, None][:2]
    filters += _periods(question.lower(), as_of, time_column or next((d.column for d in dims if d.kind == "time"), None))
    if m := OTHER_GRAIN.search(said):
        raise Ambiguous(f"{m[0]!r} is no grain that is known")
    bare = BETWEEN.sub(" ", BOUND.sub(" ", said))
    top, lowest = None, False
    if m := RANKED.search(bare):
        if m[2] is None:
            raise Ambiguous(f"{m[0]!r}: how many?")
        top, lowest = int(_number(m[2])), m[1] == "bottom"
    elif any(re.search(rf"\b{w}\b", bare) for w in (*MOST, *FEWEST)):
        top, lowest = 20, not any(re.search(rf"\b{w}\b", bare) for w in MOST)
    kpi = replace(kpi, filters=tuple(filters), having=having, also=also, top=top, lowest=lowest, measures=kpi.measures + (() if kpi.share or kpi.ratio or kpi.window else tuple(_extra(question.lower(), kpi.measures[0], labels or {}))))
    if kpi.share == "scope":
        if kpi.within[0].lower() in UNITS:
            kpi = replace(kpi, share="period", within=())
        else:
            group = resolve_group(kpi.within[0], {d.name: d.name for d in dims} | {k: v for k, v in (labels or {}).items() if v in {d.name for d in dims}}, cuts=[d.name for d in dims])
            kpi = replace(kpi, share="group" if group and denominator in (None, "within_group") and len(dims) > 1 else "total", within=(group,) if group else ())
    if denominator and kpi.share:
        kpi = replace(kpi, share={"grand_total": "total", "global_total": "total", "within_group": "group", "within_period": "period"}[denominator])
    # A measure's own input is no cut.
    inputs = {m.column for m in kpi.measures}
    return replace(kpi, dims=tuple(d for d in dims if not (d.kind == "column" and d.column in inputs and len(dims) > 1)))


def _as_of(d: Dim) -> str:
    return f"DATE '{d.by}'" if re.match(r"\d{4}-", str(d.by)) else str(d.by)


def _where_last(df: DataFrame, kpi: Kpi, dims: list[str]) -> DataFrame:
    """One row an entity, where it was last: the greatest of the latest columns, combined before the shuffle. Of equal ones, the greatest cuts."""
    used = {w for m in kpi.measures for w in re.findall(r"\w+", f"{m.column} {m.where or ''}")} & set(df.columns)
    row = F.struct(*dims, *sorted(used - {kpi.entity}))
    return df.groupBy(kpi.entity).agg(F.max_by(row, F.struct(*kpi.latest, *dims)).alias("_last")).select(kpi.entity, "_last.*")


def answer(df: DataFrame, kpi: Kpi, by_grain: bool = False) -> DataFrame:
    """The frame that the Kpi asks for; having applies to groups before shares and windows, top to what comes out, by values that are not rounded yet.

    by_grain: where no top is asked for, the rows come in order of the cuts."""
    if kpi.share and any(d.continuous for d in kpi.dims):
        raise Ambiguous("a share by a continuous value needs bands")
    first, names = kpi.measures[0], [d.name for d in kpi.dims]
    if kpi.share == "total" and kpi.filters and not kpi.dims:  # the filters make the part, not the whole
        part = replace(first, where=" AND ".join(f"({f})" for f in [*kpi.filters, *([first.where] if first.where else [])]))
        out = df.agg(part.raw().alias(first.name), first.raw().alias("_whole"))
        return out.select(first.shown(F.col(first.name)).alias(first.name), F.round(c.safe_ratio(F.col(first.name), F.col("_whole")) * 100, 2).alias("share"))
    for test in kpi.filters:
        df = df.filter(safe_expr(test))
    df = df.select("*", *[d.value().alias(f"_d{k}") for k, d in enumerate(kpi.dims)])
    keys = [F.col(f"_d{k}").alias(n) for k, n in enumerate(names)]
    if kpi.entity:
        df = _where_last(df, kpi, [f"_d{k}" for k in range(len(names))])
    out = df.groupBy(*keys).agg(*[m.raw().alias(f"_m{k}") for k, m in enumerate(kpi.measures)])
    for op, bound in [b for b in (kpi.having, kpi.also) if b]:
        x = F.col("_m0")
        out = out.filter({">=": x >= bound, ">": x > bound, "<=": x <= bound, "<": x < bound}[op])
    times = [d.name for d in kpi.dims if d.kind == "time"]
    if kpi.ratio:
        value, shown = c.safe_ratio(F.col("_m0"), F.col("_m1")), [F.round("_v", 4).alias("ratio")]
    elif kpi.share:
        scope = {"total": [], "group": list(kpi.within) or names[:1], "period": times}[kpi.share]
        if scope:
            whole = F.sum("_m0").over(Window.partitionBy(*scope))
        else:  # one row
            out, whole = out.join(F.broadcast(out.agg(F.sum("_m0").alias("_whole")))), F.col("_whole")
        value, shown = c.safe_ratio(F.col("_m0"), whole) * 100, [F.round("_v", 2).alias("share")]
    elif kpi.window == "rank":
        nth = F.row_number().over(Window.partitionBy(*kpi.within).orderBy(F.desc("_m0"), *names))
        value, shown = F.col("_m0"), [F.round("_m0", 2).alias(first.name), F.col("_nth").alias("rank")]
        out = out.withColumn("_nth", nth)
    elif kpi.window:
        w = Window.partitionBy(*[n for n in names if n not in times]).orderBy(*times)
        value = F.sum("_m0").over(w.rowsBetween(Window.unboundedPreceding, 0)) if kpi.window == "running" else F.avg("_m0").over(w.rowsBetween(1 - kpi.span, 0))
        shown = [F.round("_v", 2).alias("running_total" if kpi.window == "running" else "moving_average")]
    else:
        value, shown = F.col("_m0"), [m.shown(F.col(f"_m{k}")).alias(m.name) for k, m in enumerate(kpi.measures)]
    out = out.withColumn("_v", value)
    if kpi.top:
        out = out.orderBy(F.asc_nulls_last("_v") if kpi.lowest else F.desc_nulls_last("_v"), *names).limit(kpi.top)
    elif by_grain and names:
        out = out.orderBy(*names)
    return out.select(*names, *shown)


# Values that are aggregated again
def roll_up(frame: DataFrame, measure: str, by: list[str], additive: bool, filters: dict | None = None) -> DataFrame:
    """Sums of an additive measure; another kind only where each group is one row."""
    frame = slicer(frame, filters or {})
    if additive:
        return frame.groupBy(*by).agg(F.round(F.sum(measure), 2).alias(measure))
    if not frame.groupBy(*by).count().filter("count > 1").isEmpty():
        raise Ambiguous(f"{measure} can't be added up over {by}")
    return frame.select(*by, measure)


def slicer(frame: DataFrame, filters: dict) -> DataFrame:
    """A value, a list or {from, to} for each column; empty ones do nothing; a value of another type is compared as text."""
    kinds = dict(frame.dtypes)
    for column, wanted in filters.items():
        if wanted is None or wanted == "" or wanted == [] or wanted == {}:
            continue
        x = F.col(column)
        if isinstance(wanted, dict):
            if wanted.get("from") is not None:
                frame = frame.filter(x >= F.lit(wanted["from"]))
            if wanted.get("to") is not None:
                frame = frame.filter(x <= F.lit(wanted["to"]))
            continue
        values = list(wanted) if isinstance(wanted, (list, tuple, set)) else [wanted]
        held = [v for v in values if v is not None]
        text = kinds[column] == "string" or any(isinstance(v, str) for v in held)
        test = (x.cast("string") if text else x).isin([str(v) for v in held] if text else held)
        frame = frame.filter(test | x.isNull() if len(held) < len(values) else test)
    return frame


def others(rows: DataFrame, column: str, top: DataFrame) -> DataFrame:
    """rows with values of column that are not in `top` (column `_top`, few rows) as one: Other, or All other where a value of top is called so. Null is a value."""
    named = top.agg(F.max(F.when(F.col("_top").cast("string") == "Other", F.lit("All other")).otherwise(F.lit(None))).alias("_rest"))  # one row
    marked = rows.join(F.broadcast(top.withColumn("_in", F.lit(True))), F.col(column).eqNullSafe(F.col("_top")), "left").join(F.broadcast(named))
    return marked.withColumn(column, F.when(F.col("_in"), F.col(column).cast("string")).otherwise(F.coalesce("_rest", F.lit("Other")))).drop("_top", "_in", "_rest")


def cap_categories(frame: DataFrame, category: str, value: str, k: int) -> DataFrame:
    """The k categories with the largest totals; the others together as Other."""
    totals = frame.groupBy(category).agg(F.sum(value).alias("_t"))
    top = totals.orderBy(F.desc("_t"), category).limit(k).select(F.col(category).alias("_top"))
    return others(totals, category, top).groupBy(category).agg(F.round(F.sum("_t"), 2).alias(value))
