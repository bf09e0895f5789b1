"""Comparison of results: row by row, by signature, and what plans must not hold."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenmart.plans import trees
from lumenmart.plans.names import safe_expr


def normal(df: DataFrame) -> DataFrame:
    """Lower-case names in order; numbers to 2 places, dates by day, all as text."""
    def cell(f: T.StructField):
        x = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.NumericType):
            return F.format_string("%.2f", F.round(x.cast("double"), 2))
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return x.cast("date").cast("string")
        return x.cast("string")

    return df.select(*[cell(f).alias(f.name.lower()) for f in sorted(df.schema.fields, key=lambda f: f.name.lower())])


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one result that the other lacks, with the side; none where they agree."""
    x, y = normal(a), normal(b)
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def signature(df: DataFrame) -> DataFrame:
    """Rows, and for each column nulls, sum, least, greatest (numbers) or distinct values and an order-free checksum (others): one pass."""
    out = [F.count(F.lit(1)).alias("rows")]
    for f in sorted(df.schema.fields, key=lambda f: f.name.lower()):
        x, n = F.col(f"`{f.name}`"), f.name.lower()
        out.append(F.count_if(x.isNull()).alias(f"{n}_nulls"))
        if isinstance(f.dataType, T.NumericType):
            out += [F.round(F.sum(x.cast("double")), 2).alias(f"{n}_sum"), F.min(x).alias(f"{n}_least"), F.max(x).alias(f"{n}_greatest")]
        else:
            digest = F.conv(F.substring(F.md5(x.cast("string")), 1, 8), 16, 10).cast("bigint")
            out += [F.count_distinct(x).alias(f"{n}_distinct"), F.sum(digest).alias(f"{n}_checksum")]
    return df.agg(*out)


def multiset(df: DataFrame) -> DataFrame:
    """One row, rows, h1, h2: the same for the same rows in any order, partitions and order of columns (names regardless of case), and another for any other value.

    Values are hashed as they are, to the bit, and the hashes added exactly (38 digits); a map's entries are sorted first."""
    def cell(f: T.StructField):
        x = F.col(f"`{f.name}`")
        return F.array_sort(F.map_entries(x)) if isinstance(f.dataType, T.MapType) else x.cast("string") if isinstance(f.dataType, T.VariantType) else x

    fields = sorted(df.schema.fields, key=lambda f: f.name.lower())
    # A null leaves xxhash64 as it is, so nulls are said beside the values.
    nulls = F.concat(*[F.col(f"`{f.name}`").isNull().cast("int").cast("string") for f in fields]) if fields else F.lit("")
    hashed = [F.xxhash64(F.lit(seed), nulls, *[cell(f) for f in fields]).cast("decimal(38,0)") for seed in (1, 2)]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(hashed[0]).alias("h1"), F.sum(hashed[1]).alias("h2"))


def same_result(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: whether two runs gave the same columns, types and rows, in any order; two hashes of the rows are compared, not the rows."""
    shape = lambda df: sorted((f.name.lower(), f.dataType.simpleString()) for f in df.schema.fields)
    if shape(before) != shape(after):
        return before.sparkSession.createDataFrame([(False,)], "same boolean")
    a, b = multiset(before), multiset(after)
    both = a.select(F.struct(*a.columns).alias("a")).join(F.broadcast(b.select(F.struct(*b.columns).alias("b"))))  # one row each
    return both.select(F.col("a").eqNullSafe(F.col("b")).alias("same"))


def reproduces(full: DataFrame, gold: DataFrame, keys: list[str], measure: str, tolerance: float = 1e-6) -> bool:
    """Whether both have the same groups (null is one) with the same values, and so the same total."""
    left = full.select(*[F.col(k).alias(f"_l{n}") for n, k in enumerate(keys)], F.col(measure).alias("_a"), F.lit(1).alias("_in_a"))
    right = gold.select(*[F.col(k).alias(f"_r{n}") for n, k in enumerate(keys)], F.col(measure).alias("_b"), F.lit(1).alias("_in_b"))
    same = F.lit(True)
    for n in range(len(keys)):
        same &= F.col(f"_l{n}").eqNullSafe(F.col(f"_r{n}"))
    near = F.abs(F.col("_a") - F.col("_b")) <= F.greatest(F.lit(0.01), F.abs("_b") * tolerance)
    fits = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull() & F.coalesce(near, F.col("_a").isNull() & F.col("_b").isNull())
    return left.join(right, same, "full").filter(~fits).isEmpty()


def column_lineage(df: DataFrame) -> list[tuple[str, str, str]]:
    """(table.column, output column or *, how): see `plans.trees.lineage`. It does not matter whether SQL or DataFrames made df."""
    return trees.lineage(df)


def coverage(kpi, df: DataFrame, edges: Sequence[tuple[str, str]] = ()) -> list[str]:
    """What a result lacks of what was asked for, by the tree of its plan: cuts, dates where time is cut, measures (their function and input), filters and bounds with their
    operators and literals, both sides of a ratio, the number of rows, and joins (column, key)."""
    found, columns, spark = [], {f.name: f.dataType for f in df.schema.fields}, df.sparkSession
    for d in kpi.dims:
        if d.name not in columns:
            found.append(f"grain: {d.name} lacks")
        elif d.kind == "time" and not isinstance(columns[d.name], (T.DateType, T.TimestampType, T.TimestampNTZType)):
            found.append(f"time: {d.name} is no date")
    shown = {"ratio"} if kpi.ratio else {"share"} if kpi.share else {"running": {"running_total"}, "moving": {"moving_average"}, "rank": {"rank"}}.get(kpi.window) or {m.name for m in kpi.measures}
    found += [f"measure: {m} lacks" for m in sorted(shown - set(columns))]
    plan = trees.Plan(df)
    # What is asked is analysed over an empty table with the columns of the tables that the plan reads, and so has the same form.
    leaves = {a.fields["name"]: a.fields["dataType"] for op in plan.root.walk() if not op.children for a in op.expressions.get("output", [])}
    schema = T.StructType([T.StructField(n, T.StructType.fromJson({"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}}]})[0].dataType) for n, t in leaves.items()])
    empty = spark.createDataFrame([], schema)

    def lacks(asked: Callable[[], set[str]], held: set[str]) -> bool:
        try:
            return not asked() <= held
        except AnalysisException:  # it names a column that no table of the plan has
            return True

    tests, aggregates = plan.tests(), plan.aggregates()
    for test in kpi.filters:
        if lacks(lambda t=test: trees.Plan(empty.filter(safe_expr(t))).tests(), tests):
            found.append(f"filter: {test} lacks")
    for m in kpi.measures:
        if m.name in columns and lacks(lambda m=m: trees.Plan(empty.agg(m.raw().alias("m"))).aggregates(), aggregates):
            found.append(f"measure: {m.name} is another aggregate")
    for op, bound in [b for b in (kpi.having, kpi.also) if b]:
        if lacks(lambda o=op, b=bound: trees.Plan(empty.agg(kpi.measures[0].raw().alias("m")).filter(f"m {o} {b}")).tests(), tests):
            found.append(f"bound: {kpi.measures[0].name} {op} {bound:g} lacks")
    if kpi.ratio and "ratio" in columns:
        form = plan.form(plan.out[df.columns.index("ratio")])
        for side, m in zip(("numerator", "denominator"), kpi.measures, strict=False):
            if lacks(lambda m=m: trees.Plan(empty.agg(m.raw().alias("m"))).aggregates(), {a for a in aggregates if a in form}):
                found.append(f"ratio: {side} {m.name} lacks")
    if kpi.top and (limits := plan.limits())[:1] != [kpi.top]:
        found.append(f"shape: limited to {limits[0]}, not {kpi.top}" if limits else f"shape: not limited to {kpi.top}")
    joined = plan.tests("joined")
    found += [f"join: {a} = {b} lacks" for a, b in edges if f"EqualTo({', '.join(sorted((a, b)))})" not in joined]
    return found


def heavy_operators(df: DataFrame) -> list[str]:
    """Operators in the plan that compare everything with everything."""
    plan = df._jdf.queryExecution().executedPlan().toString()  # no public way to a plan's operators
    return [name for name in ("CartesianProduct", "BroadcastNestedLoopJoin") if name in plan]


def settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the folder that the session names for checkpoints; as it is where none is named."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def walk(edges: DataFrame, start: str, came: str, goes: str) -> DataFrame:
    """name, distance of all that edges lead to from start, from column `came` to column `goes`: a join a step, each name once, until a step finds nothing new."""
    at = found = edges.sparkSession.createDataFrame([(start, 0)], "name string, distance int")
    step = 0
    while not at.isEmpty():
        step += 1
        near = edges.join(at.select("name"), edges[came] == at["name"], "left_semi").select(F.col(goes).alias("name")).distinct()
        at = settled(near.join(found, "name", "left_anti").withColumn("distance", F.lit(step)))
        found = settled(found.unionByName(at))
    return found


def lineage(edges: DataFrame, start: str) -> DataFrame:
    """All columns that `start` comes from, with the distance: source -> target edges walked back."""
    return walk(edges, start, "target", "source")
