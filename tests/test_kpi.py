import pytest

from lumenmart.operators import kpi

SALES = [("NA", 10, "2024-01-03"), ("NA", 5, "2024-02-01"), ("EU", 20, "2024-01-09"), ("EU", 7, "2024-02-11"), ("APAC", 3, "2024-02-20")]


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(SALES, "region string, amount int, day string").selectExpr("region", "amount", "date(day) AS day")


def rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def test_sum_by_region(sales):
    assert rows(kpi.answer(sales, kpi.read("sum(amount)", "region"))) == [("APAC", "3"), ("EU", "27"), ("NA", "15")]


def test_month_and_region(sales):
    got = rows(kpi.answer(sales, kpi.read("sum(amount)", "region, Month(day)")))
    assert ("EU", "2024-02-01", "7") in got and len(got) == 5


def test_running_total_moving_average_and_rank(sales):
    running = rows(kpi.answer(sales, kpi.read("running total of sum(amount)", "Month(day), region")))
    assert ("2024-02-01", "EU", "27") in running and ("2024-02-01", "NA", "15") in running
    moving = rows(kpi.answer(sales, kpi.read("2-month moving average of sum(amount)", "Month(day), region")))
    assert ("2024-02-01", "EU", "13.5") in moving
    ranked = rows(kpi.answer(sales, kpi.read("rank of sum(amount) within month", "Month(day), region")))
    assert ("2024-01-01", "EU", "20", "1") in ranked and ("2024-02-01", "APAC", "3", "3") in ranked


def test_shares_sum_to_a_hundred(sales):
    total = [r.share for r in kpi.answer(sales, kpi.read("percentage of total sum(amount)", "region")).collect()]
    assert abs(sum(total) - 100) < 0.05
    once = kpi.answer(sales, kpi.Kpi((kpi.Measure("count_distinct", "region"),), (kpi.Dim("day", "time", "month"),), share="total", entity="region", latest=("day",)))
    assert rows(once) == [("2024-02-01", "100.0")]


def test_share_by_a_continuous_value_needs_bands(sales):
    with pytest.raises(kpi.Ambiguous):
        kpi.answer(sales, kpi.read("percentage of total sum(amount)", "Age(day)", as_of="2024-12-31"))


def test_wordings():
    assert kpi.read("sum(amount)", "region", "at least 10 orders").having == (">=", 10.0)
    assert kpi.read("sum(amount)", "region", "more than 10 orders").having == (">", 10.0)
    assert kpi.read("sum(amount)", "region", "top 3").top == 3 and kpi.read("sum(amount)", "region", "the highest").top == 20
    assert kpi.read("mean(amount)").measures[0].function == "avg" and kpi.read("sum(distinct id)").measures[0].function == "count_distinct"
    assert [d.name for d in kpi.read("sum(amount)", "amount, region").dims] == ["region"]  # a measure's input is no cut
    with pytest.raises(kpi.Ambiguous):
        kpi.read("sudden(amount)")


def test_ratio_guards_zero(spark):
    df = spark.createDataFrame([("a", 6, 3), ("b", 1, 0)], "c string, orders int, sessions int")
    assert rows(kpi.answer(df, kpi.read("sum(orders) / sum(sessions)", "c"))) == [("a", "2.0"), ("b", "None")]


def test_roll_up_only_adds_what_adds_up(spark):
    mart = spark.createDataFrame([("2024-01", "A", "M", 100.0), ("2024-01", "B", "F", 50.0), ("2024-02", "A", "M", 200.0), ("2024-02", "B", "F", 25.0)], "month string, payor string, gender string, paid double")
    assert rows(kpi.roll_up(mart, "paid", ["month"], True)) == [("2024-01", "150.0"), ("2024-02", "225.0")]
    assert rows(kpi.roll_up(mart, "paid", ["payor"], True, {"month": "2024-02", "gender": []})) == [("A", "200.0"), ("B", "25.0")]
    with pytest.raises(kpi.Ambiguous):
        kpi.roll_up(mart, "paid", ["month"], False)
    assert kpi.roll_up(mart, "paid", ["month", "payor"], False).count() == 4


def test_cap_categories(spark):
    df = spark.createDataFrame([(c, v) for c, v in zip("abcd", (9, 7, 2, 1), strict=True)], "c string, v int")
    assert rows(kpi.cap_categories(df, "c", "v", 2)) == [("Other", "3"), ("a", "9"), ("b", "7")]
