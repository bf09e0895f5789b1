from pyspark.sql import functions as F

from lumenmart.sources import files, web
from lumenmart.sources.versions import Versions


def source(spark, tmp_path, name, bad=()):
    """Pages of three rows; page 2 is empty, those of `bad` fail; a file says how many pages there are."""
    at = str(tmp_path / "total")

    def fetch(asked):
        k = asked["page"]
        if k in bad:
            raise OSError("no answer")
        return [] if k == 2 else [{"k": 3 * k + i, "v": None if i else "first"} for i in range(3)]

    def total():
        with open(at) as f:
            return int(f.read())

    return web.register_pages(spark, name, fetch, total, "k long, v string", 2), fetch, lambda n: (tmp_path / "total").write_text(str(n))


def test_stream_of_pages_goes_on_where_it_stopped(spark, tmp_path):
    name, fetch, publish = source(spark, tmp_path, "pages_a", bad=(4,))
    table, went = Versions(spark, str(tmp_path / "t")), []
    keys = lambda: sorted(r.k for r in files.page_rows(table).collect())
    for n, checkpoint in ((3, "c"), (7, "c"), (7, "c"), (8, "new")):
        publish(n)
        web.load_stream(spark, name, table, str(tmp_path / checkpoint))
        went.append(len(keys()))
    assert went == [6, 15, 15, 18] and keys() == [k for k in range(24) if k // 3 not in (2, 4)]
    assert {r.page for r in table.read("pages").collect()} == {0, 1, 2, 3, 5, 6, 7} and {(r.page, r.error) for r in table.read("quarantine").collect()} == {(4, "OSError: no answer")}
    assert web.retry(spark, table, lambda asked: [{"k": 3 * asked["page"] + i} for i in range(3)], "k long, v string") == (1, 0)
    assert keys() == [k for k in range(24) if k // 3 != 2]


def test_batch_that_broke_off_comes_once(spark, tmp_path, monkeypatch):
    name, _, publish = source(spark, tmp_path, "pages_b")
    publish(5)
    table, append = Versions(spark, str(tmp_path / "t")), Versions.append_with

    def breaks(self, *args):
        append(self, *args)
        raise RuntimeError("lost after the commit")

    monkeypatch.setattr(Versions, "append_with", breaks)
    try:
        web.load_stream(spark, name, table, str(tmp_path / "c"))
        raise AssertionError("did not break")
    except Exception as e:
        assert "lost after the commit" in str(e)
    monkeypatch.setattr(Versions, "append_with", append)
    web.load_stream(spark, name, table, str(tmp_path / "c"))
    assert files.page_rows(table).count() == 12


def test_in_one_go_and_without_pages(spark, tmp_path):
    name, _, publish = source(spark, tmp_path, "pages_c", bad=(1,))
    publish(4)
    rows = spark.read.format(name).load()
    assert rows.filter("_error IS NULL AND NOT _empty").count() == 6 and rows.agg(F.max("_page")).first()[0] == 3 and rows.rdd.getNumPartitions() == 2
    publish(0)
    assert spark.read.format(name).load().count() == 0
