import random

import duckdb

from lumenmart.llm import url_filter

URLS = [
    "https://WWW.Example.ORG/es/1?x=/fr/", "http://example.org/en/17", "http://a.example.org/en/2#q", "http://b.com/fr/1", "http://b.com/de/1", "http://b.com",
    "no scheme", None, "", "http://notorg/es/", "ftp://x.org?y=/", "http://Äb.com/fr/", "http://b.com/" + "a/" * 500,
]


def test_rules_host_and_path(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert len(got) == len(URLS)
    assert got[0] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert got[1][2:] == ("example.org/en/1", "block") and got[2][2:] == ("org/", "allow")
    assert got[3][2:] == ("com/fr/", "allow") and got[4][2:] == ("com/de/", "block")
    assert got[5][:3] == ("b.com", "", None) and got[6][:3] == got[7][:3] == got[8][:3] == ("", "", None)
    assert got[9][2] is None and got[10][:3] == ("x.org", "", None) and got[11][0] == "Äb.com".replace("Ä", "Ä")


def test_branches_split_and_merge(spark):
    urls = [f"http://s.com/de/{k}" for k in range(40)] + [f"http://s.com/fr/{k}" for k in range(40)]
    urls += [f"http://only.com/de/{k}" for k in range(20)] + ["http://only.com/es/1", "http://free.net/de/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert got[0].template == "/de/*" and got[40].template == "/fr/*"  # unlike branches stay apart
    assert got[100].template == "/*/*" and got[100].verdict == "block"  # alike branches merge; the host's others are blocked
    assert got[101].verdict == "allow"  # no labels: the prior


def test_empty_and_repeated(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x")], "page_id long, url string")
    assert url_filter.judge(pages).count() == 2 and url_filter.judge(pages.limit(0)).count() == 0


def test_like_siblings_merge_at_any_depth(spark):
    """Branches with labels of one kind go on with wildcards; below six levels with labels of both kinds, bad and worse merge and good stays apart."""
    blocked, allowed, free = url_filter.Rule("block", "m.com", "/bad/"), url_filter.Rule("allow", "m.com", "/good/"), "other"
    deep = "s/t/u/v/w/x/y"
    urls = [f"http://m.com/{kind}/{deep}/{branch}/{k}" for k in range(30) for kind, branches in (("bad", "abc"), ("good", "de"), (free, "af")) for branch in branches]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {u: r for u, r in zip(urls, sorted(url_filter.judge(pages, rules=(blocked, allowed)).collect(), key=lambda r: r.page_id), strict=True)}
    assert got[f"http://m.com/bad/{deep}/a/1"].template == "/bad" + "/*" * 9 and got[f"http://m.com/good/{deep}/d/1"].template == "/good" + "/*" * 9
    kinds = [url_filter.Rule(v, "n.com", f"/{k}/2/3/4/5/6/{b}") for k in range(40) for v, b in (("block", "bad"), ("block", "worse"), ("allow", "good"))]
    urls = [f"http://n.com/{k}/2/3/4/5/6/{b}/k" for k in range(40) for b in ("bad", "worse", "good", "new")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = sorted(url_filter.judge(pages, rules=tuple(kinds)).collect(), key=lambda r: r.page_id)
    assert [r.template for r in rows[:4]] == ["/*/*/*/*/*/*/*2/*", "/*/*/*/*/*/*/*2/*", "/*/*/*/*/*/*/good/*", "/*/*/*/*/*/*/*/*"]
    assert rows[0].purity > 0.9 and rows[2].purity < 0.1


def test_equals_the_sql_on_deep_and_mixed_paths(spark):
    rng, rows = random.Random(7), []
    for _ in range(1500):
        segs = [rng.choice(["de", "fr", "es", "en", "en/1"])] * (rng.random() < 0.8) + [rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 2, 3, 9]))]
        rows.append(f"http://{rng.choice(['a.com', 'b.com', 'x.example.org', 'n.net'])}/" + "/".join(segs))
    rows += ["http://q.com/" + "a/" * 400, "http://q.com/de/" + "a/" * 300, None, "", "http://q.com", "http://long.net/" + "x" * 100_000]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    db = duckdb.connect()
    db.register("pages", pages.toPandas())
    got = sorted(tuple(r) for r in url_filter.judge(pages).collect())
    assert [tuple(map(repr, r)) for r in got] == [tuple(map(repr, r)) for r in sorted(db.execute(url_filter.sql()).fetchall())]
