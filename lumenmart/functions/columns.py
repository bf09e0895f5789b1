"""Column builders for metrics, cleaning and masking; all of them built-in expressions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Time
def time_bucket(unit: str, c: Column) -> Column:
    """First day of the year, quarter, month or week, or the day."""
    return F.date_trunc(unit, c).cast("date")


def temporal_ladder(c: Column, name: str) -> dict[str, Column]:
    """Year, quarter, month and day of a date, as dates, by column name."""
    return {f"{name}_{unit}": time_bucket(unit, c) for unit in ("year", "quarter", "month", "day")}


def age_calendar(born: Column, as_of: Column) -> Column:
    """Difference of calendar years."""
    return F.year(as_of) - F.year(born)


def age_completed(born: Column, as_of: Column) -> Column:
    """Years that are over."""
    return F.floor(F.months_between(as_of, born) / 12).cast("int")


def days_since(day: Column, as_of: Column) -> Column:
    return F.datediff(as_of, day)


def elapsed(unit: str, start: Column, stop: Column) -> Column:
    """Whole units from start to stop."""
    return F.timestamp_diff(unit, start, stop)


def boundaries(unit: str, start: Column, stop: Column) -> Column:
    """Unit borders between start and stop: the other reading of a difference."""
    return F.timestamp_diff(unit, F.date_trunc(unit, start), F.date_trunc(unit, stop))


def lenient_date(c: Column) -> Column:
    return F.try_to_date(c)


def lag_hours(latest: Column, now: Column) -> Column:
    return elapsed("HOUR", latest, now)


# Bands
def band(c: Column, width: float) -> Column:
    return (F.floor(c / F.lit(width)) * F.lit(width)).cast("bigint")


def band_label(c: Column, width: int) -> Column:
    low = band(c, width)
    return F.concat_ws("-", low, low + (width - 1))


#: Upper ends of the age bands and their names.
AGE_BANDS = ((18, "<18"), (35, "18-34"), (50, "35-49"), (65, "50-64"))


def age_band(age: Column) -> Column:
    return reduce(lambda out, b: F.when(age < b[0], b[1]).otherwise(out), AGE_BANDS[::-1], F.when(age.isNotNull(), "65+"))


# Amounts
def net(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))


def to_unit(value: Column, unit: Column, factors: Mapping[str, float]) -> Column:
    """value in the base unit; null for an unknown unit."""
    name = F.upper(F.trim(unit))
    return value * reduce(lambda out, f: F.when(name == f[0].upper(), F.lit(f[1])).otherwise(out), list(factors.items())[::-1], F.lit(None).cast("double"))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0)))


# Masks
def masked(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def salted(c: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.coalesce(c.cast("string"), F.lit("")), F.lit(salt)), 256)


def redacted(c: Column, placeholder: str = "<redacted-pii>") -> Column:
    return F.when(c.isNotNull(), F.lit(placeholder))


def old_age_together(age: Column) -> Column:
    """Ages over 89 as one value."""
    return F.when(age > 89, "90+").otherwise(age.cast("string"))


def surrogate_key(*keys: Column) -> Column:
    """A hash of the keys' lengths and texts, so that no two lists of keys, nulls among them, are one text."""
    part = lambda k: F.when(k.isNull(), F.lit("-")).otherwise(F.concat(F.length(k.cast("string")), F.lit(":"), k.cast("string")))
    return F.sha2(F.concat_ws("|", *[part(k) for k in keys]), 256)


# Values
#: Shapes of values, tried in this order; those of identifiers and codes, that say nothing to a reader; and of dates with a time.
SHAPES = {"currency_2dp": r"^-?\d+\.\d{2}$", "iso_date": r"^\d{4}-\d{2}-\d{2}$", "prefixed_numeric_code": r"^[A-Za-z]+[-_]?\d+$", "fixed_length_alnum": r"^[A-Za-z0-9]{6,12}$"}
IDENTIFIER, HEX = r"(?i)^[0-9a-f]{6,}-[0-9a-f-]{6,}", r"(?i)^[0-9a-f]{12,}$"
CODE = r"^([A-Za-z]{0,8}[-_#]?)?\d[\d.-]*$"
DATE_OR_TIME = r"^\s*\d{4}[-/]\d{1,2}[-/]\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?)?\s*$"
SHAPE_SHARE, KIND_SHARE, LEAST_VALUES, LONG_LABEL = 0.8, 0.6, 3, 16


def has_shape(c: Column, kind: T.DataType, shape: str) -> Column:
    """Whether a value has the shape. Money as a number is one that two decimals hold; whole numbers are no money, and digits of a number no code."""
    if shape == "fixed_length_alnum" and isinstance(kind, T.NumericType):
        return F.lit(False)
    if shape == "currency_2dp" and not isinstance(kind, T.StringType):
        return F.abs(F.round(c, 2) - c) < 1e-9 if isinstance(kind, (T.FractionalType, T.DecimalType)) else F.lit(False)
    return c.cast("string").rlike(SHAPES[shape])


def _there(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c.cast("string")) != "")


def shape_share(c: Column, shape: str, kind: T.DataType | None = None) -> Column:
    """Aggregate: share of the values that are there which have the shape."""
    return F.avg(F.when(_there(c), has_shape(c, kind or T.StringType(), shape).cast("int")))


def shape_of(c: Column, kind: T.DataType) -> Column:
    """Aggregate: the first shape that four of five values have, or null."""
    return F.coalesce(*[F.when(shape_share(c, s, kind) >= SHAPE_SHARE, s) for s in SHAPES])


def value_kind(c: Column) -> Column:
    """Aggregate: identifier, temporal, code, long_label or label, by three of five values or the mean length; null with fewer than three values."""
    text = c.cast("string")
    share = lambda *patterns: F.avg(F.when(_there(c), reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns]).cast("int")))
    kind = F.when(share(IDENTIFIER, HEX) >= KIND_SHARE, "identifier").when(share(DATE_OR_TIME) >= KIND_SHARE, "temporal").when(share(CODE) >= KIND_SHARE, "code")
    return F.when(F.count(c) >= LEAST_VALUES, kind.when(F.avg(F.length(text)) > LONG_LABEL, "long_label").otherwise("label"))


def json_leaf(c: Column, path: str) -> Column:
    return F.get_json_object(c, path)


def unknown_member(c: Column, kind: T.DataType) -> Column:
    """c with its type's member for "unknown" in the place of nulls; flags and containers stay null."""
    if isinstance(kind, T.NumericType):
        return F.coalesce(c, F.lit(-1).cast(kind))
    if isinstance(kind, T.StringType):
        return F.coalesce(c, F.lit("Unknown"))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(c, F.lit("1900-01-01").cast(kind))
    return c


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
