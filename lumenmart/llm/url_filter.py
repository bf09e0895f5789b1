"""URL filtering by host rules and, where no rule fits, by a tree of path templates for each host.

Everything is DataFrame expressions. The urls that a rule decides are the labelled ones. Urls of a host that differ only in
numbers fall into one shape before the tree is built, so a hot host is as many rows as it has shapes. Level by level, as deep as paths go, the
segments below one parent are put in the order of their share of blocked urls, and neighbours whose shares are statistically alike (a two-sided test of
two proportions) merge: a branch of several segments is called `*1`, `*2` ... by rising share, one that stays alone keeps its name, and where all are
alike, where a segment has no label, or where segments are variable (many of them, few urls each), it is the wildcard `*`. Templates then carry a
purity, the share of blocked urls among labelled ones smoothed towards the parent's: (blocked + alpha * purity of parent) / (labelled + alpha). A url
is rejected where its deepest template reaches `reject_at`.

A template whose labels are all of one kind, or that holds one shape, can only go on with wildcards: what is left of its paths is written down at once,
so a level is a step only while shapes with labels of both kinds still share a template.

Defined results: a null url, or one without `://`, has empty host and path, fits no rule and is judged by the root's prior;
equal urls are judged alike, each row on its own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenmart.llm.common import kept


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the production query.
RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)

HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"


@dataclass(frozen=True)
class Settings:
    """children, variety: from how many segments, and segments a url, a level is variable; z: of the test; alpha, prior: of the smoothing."""

    children: int = 12
    variety: float = 0.2
    z: float = 2.0
    alpha: float = 4.0
    prior: float = 0.5
    reject_at: float = 0.6


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def _longest(rules: tuple[Rule, ...], host: Column, path: Column, what: str) -> Column:
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        found = F.when(fits(rule, host, path), getattr(rule, what)).otherwise(found)
    return found


def segments(path: Column) -> Column:
    """Non-empty segments; digits are `*` (an extension stays)."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, "[0-9]+", "*"))


def _settled(shapes: DataFrame) -> DataFrame:
    """shapes with `lengths`: where their template can only go on with wildcards, its labels by length of path; null elsewhere."""
    lengths = shapes.groupBy("host", "template", F.size("segs").alias("length")).agg(
        F.count(F.lit(1)).alias("shapes"), F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )
    whole = lengths.groupBy("host", "template").agg(
        F.sum("shapes").alias("shapes"), F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.collect_list(F.struct("length", "bad", "good")).alias("lengths")
    )
    settled = whole.filter("bad = 0 OR good = 0 OR shapes = 1").select("host", "template", "lengths")
    return shapes.join(settled, ["host", "template"], "left")


def _to_the_end(settled: DataFrame, d: int, s: Settings) -> DataFrame:
    """Wildcards for all that is left, and the purity that level after level would give."""
    zero = F.struct(F.lit(0).cast("long").alias("bad"), F.lit(0).cast("long").alias("good"))

    def level(purity, j):
        deeper = F.filter("lengths", lambda x: x["length"] >= j)
        c = F.aggregate(deeper, zero, lambda a, x: F.struct((a["bad"] + x["bad"]).alias("bad"), (a["good"] + x["good"]).alias("good")))
        return (c["bad"] + s.alpha * purity) / (c["bad"] + c["good"] + s.alpha)

    purity = F.aggregate(F.sequence(F.lit(d + 1), F.size("segs")), F.col("purity"), level)
    template = F.concat("template", F.expr(f"repeat('/*', size(segs) - {d})"))
    return settled.select("host", "segs", "n", "bad", "good", template.alias("template"), purity.alias("purity"), F.lit(True).alias("over"))


def _branches(below: DataFrame, s: Settings) -> DataFrame:
    """host, template, child, token: what each segment below a template is called. below: host, template, child, n, bad, good.

    Children with equal counts are one row before they are put in order, so a window holds far fewer rows than a parent has children."""
    group, labels = Window.partitionBy("host", "template"), F.col("bad") + F.col("good")
    order = group.orderBy("share", "labels")
    classes = below.filter(labels > 0).groupBy("host", "template", "bad", "good").agg(F.count(F.lit(1)).alias("kids"))
    classes = classes.withColumn("labels", labels).withColumn("share", F.col("bad") / F.col("labels"))
    classes = classes.withColumn("bad0", F.lag("bad").over(order)).withColumn("labels0", F.lag("labels").over(order)).withColumn("share0", F.lag("share").over(order))
    pooled = (F.col("bad") + F.col("bad0")) / (F.col("labels") + F.col("labels0"))
    unlike = F.abs(F.col("share") - F.col("share0")) > s.z * F.sqrt(pooled * (1 - pooled) * (1 / F.col("labels") + 1 / F.col("labels0")))
    classes = classes.withColumn("branch", 1 + F.sum(F.when(unlike, 1).otherwise(0)).over(order))
    classes = classes.withColumn("kids", F.sum("kids").over(Window.partitionBy("host", "template", "branch"))).withColumn("branches", F.max("branch").over(group))
    parent = below.groupBy("host", "template").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("all_n"))
    variable = (F.col("k") >= s.children) & (F.col("k") >= s.variety * F.col("all_n"))
    named = F.when(variable | F.col("branch").isNull() | (F.col("branches") == 1), "*").when(F.col("kids") == 1, F.col("child")).otherwise(F.concat(F.lit("*"), "branch"))
    found = below.join(parent, ["host", "template"]).join(classes.select("host", "template", "bad", "good", "branch", "branches", "kids"), ["host", "template", "bad", "good"], "left")
    return found.select("host", "template", "child", named.alias("token"))


def _level(shapes: DataFrame, d: int, s: Settings) -> DataFrame:
    """shapes (paths longer than d) with level d added to their template and purity; over: whether the path ends there."""
    shapes = shapes.withColumn("child", F.get(F.col("segs"), d))
    below = shapes.groupBy("host", "template", "child").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    longer = shapes.join(_branches(below, s), ["host", "template", "child"]).withColumn("template", F.concat("template", F.lit("/"), "token"))
    counts = longer.groupBy("host", "template").agg(F.sum("bad").alias("t_bad"), F.sum("good").alias("t_good"))
    pure = (F.col("t_bad") + s.alpha * F.col("purity")) / (F.col("t_bad") + F.col("t_good") + s.alpha)
    return longer.join(counts, ["host", "template"]).select("host", "segs", "n", "bad", "good", "template", pure.alias("purity"), (F.size("segs") == d + 1).alias("over"))


def templates(judged: DataFrame, s: Settings) -> DataFrame:
    """host, segs, template, purity: a row for each shape of urls. judged: host, segs, by_rule."""
    shapes = judged.groupBy("host", "segs").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("by_rule") == "block").alias("bad"), F.count_if(F.col("by_rule") == "allow").alias("good")
    )
    shapes = kept(shapes, "shapes")
    root = shapes.groupBy("host").agg(((F.sum("bad") + s.alpha * s.prior) / (F.sum("bad") + F.sum("good") + s.alpha)).alias("purity"))
    level = shapes.join(root, "host").select("host", "segs", "n", "bad", "good", F.lit("").alias("template"), "purity", (F.size("segs") == 0).alias("over"))
    found, d = level.filter("over"), 0
    while True:
        marked = kept(_settled(level.filter("NOT over")), "shapes")
        found = found.unionByName(_to_the_end(marked.filter("lengths IS NOT NULL"), d, s))
        still = marked.filter("lengths IS NULL")
        if still.isEmpty():
            return found.select("host", "segs", "template", "purity")
        level = kept(_level(still.drop("lengths"), d, s), "shapes")
        found, d = found.unionByName(level.filter("over")), d + 1


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, settings: Settings | None = None) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, template, purity."""
    s = settings or Settings()
    urls = pages.select(pages[id_col].alias("page_id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    host, path = F.col("host"), F.col("path")
    judged = urls.select("*", _longest(rules, host, path, "name").alias("rule"), _longest(rules, host, path, "verdict").alias("by_rule"), segments(path).alias("segs"))
    tree = templates(judged, s)
    verdict = F.coalesce("by_rule", F.when(F.col("purity") >= s.reject_at, "block").otherwise("allow"))
    return judged.join(tree, ["host", "segs"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def sql(s: Settings | None = None) -> str:
    """The same rows in DuckDB's SQL, levels written out."""
    s = s or Settings()

    def pick(what):
        found = "NULL"
        for r in sorted(RULES, key=lambda r: len(r.name)):
            found = f"CASE WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, what)}' ELSE {found} END"
        return found

    branch = "PARTITION BY host, template"
    return f"""WITH RECURSIVE urls AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{HOST}', 1), '{ascii_uppercase}', '{ascii_lowercase}') AS host,
        regexp_extract(coalesce(url, ''), '{PATH}', 1) AS path FROM pages),
    judged AS (SELECT *, {pick("name")} AS rule, {pick("verdict")} AS by_rule,
        list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: regexp_replace(x, '[0-9]+', '*', 'g')) AS segs FROM urls),
    shapes AS (SELECT host, segs, count(*) AS n, count(*) FILTER (by_rule = 'block') AS bad, count(*) FILTER (by_rule = 'allow') AS good FROM judged GROUP BY ALL),
    levels AS (
        SELECT 0 AS d, host, segs, n, bad, good, '' AS template, (sum(bad) OVER w + {s.alpha} * {s.prior}) / (sum(bad) OVER w + sum(good) OVER w + {s.alpha}) AS purity
        FROM shapes WINDOW w AS (PARTITION BY host)
        UNION ALL
        SELECT d + 1, host, segs, n, bad, good, template || '/' || token, (sum(bad) OVER t + {s.alpha} * purity) / (sum(bad) OVER t + sum(good) OVER t + {s.alpha})
        FROM (SELECT *, CASE WHEN k >= {s.children} AND k >= {s.variety} * all_n OR m = 0 OR branches = 1 THEN '*' WHEN kids = 1 THEN child ELSE '*' || branch END AS token
            FROM (SELECT *, count(DISTINCT child) OVER ({branch}, m > 0, branch) AS kids, max(branch) OVER ({branch}, m > 0) AS branches
                FROM (SELECT *, 1 + sum(CASE WHEN abs(share - share0) > {s.z} * sqrt(pooled * (1 - pooled) * (1.0::DOUBLE / m + 1.0::DOUBLE / m0)) THEN 1 ELSE 0 END) OVER ({branch}, m > 0 ORDER BY share, m) AS branch
                    FROM (SELECT *, (b + b0)::DOUBLE / (m + m0) AS pooled
                        FROM (SELECT *, lag(share) OVER o AS share0, lag(m) OVER o AS m0, lag(b) OVER o AS b0
                            FROM (SELECT *, b + g AS m, b::DOUBLE / nullif(b + g, 0) AS share
                                FROM (SELECT *, segs[d + 1] AS child, sum(bad) OVER ({branch}, segs[d + 1]) AS b, sum(good) OVER ({branch}, segs[d + 1]) AS g,
                                        count(DISTINCT segs[d + 1]) OVER ({branch}) AS k, sum(n) OVER ({branch}) AS all_n
                                    FROM levels WHERE len(segs) > d))
                            WINDOW o AS ({branch}, m > 0 ORDER BY share, m))))))
        WINDOW t AS (PARTITION BY host, template, token))
    SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN purity >= {s.reject_at} THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 6) AS purity
    FROM judged LEFT JOIN (FROM levels WHERE d = len(segs)) USING (host, segs)"""
