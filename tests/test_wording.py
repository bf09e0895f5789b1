import pytest
from pyspark.sql import functions as F

from lumenmart.operators import evidence, kpi, quality, sampling, semantic
from lumenmart.plans import names


def test_a_bound_that_cannot_be_placed_is_an_error():
    with pytest.raises(kpi.Ambiguous):
        kpi.read("count(*)", "region", "regions over 40")
    with pytest.raises(kpi.Ambiguous):
        kpi.read("sum(revenue)", "", "revenue per month")
    assert kpi.read("count(*)", "region", "at least 40 patients").having == (">=", 40.0)
    assert kpi.read("count(*)", "region", "having above 40 orders").having == (">", 40.0)
    assert kpi.read("count(*)", "Age(born)", "patients over 50", as_of="2024-01-01").filters == ("year(DATE '2024-01-01') - year(born) > 50",)


def test_values_in_prose():
    assert kpi.read("sum(x)", "LineOfBusiness", "paid for medicare lob").filters == ("LineOfBusiness = 'Medicare'",)
    assert kpi.read("sum(x)", "region", "region 'EMEA' only").filters == ("region = 'EMEA'",)
    assert kpi.read("sum(x)", "region", "the region 'a long phrase of words' says nothing").filters == ()
    assert kpi.read("sum(x)", "region, status != 'open', n >= 3").filters == ("status != 'open'", "n >= 3")


def test_grains_and_second_measures():
    for said, unit in (("each quarter over time", "quarter"), ("daily", "day"), ("by week", "week"), ("month over time", "month"), ("annual", "year")):
        assert kpi.read("sum(x)", "", said, time_column="d").dims[0] == kpi.Dim("d", "time", unit)
    got = kpi.read("count(*)", "region", "visits and the average base cost for each", labels={"Base Cost": "base_cost"})
    assert got.measures == (kpi.Measure("count"), kpi.Measure("avg", "base_cost"))
    assert len(kpi.read("count(*)", "region", "visits and the average weather for each", labels={"Base Cost": "base_cost"}).measures) == 1


def test_top_having_and_windows_compose(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("b", 1, 1), ("c", 1, 90)], "g string, t int, x int")
    running = kpi.Kpi((kpi.Measure("sum", "x"),), (kpi.Dim("t"),), window="running", top=1)
    assert [tuple(r) for r in kpi.answer(df.select("t", "x"), running).collect()] and kpi.answer(df, running).count() == 1
    share = kpi.Kpi((kpi.Measure("sum", "x"),), (kpi.Dim("g"),), share="total", having=(">=", 10.0), top=1)
    assert [tuple(r) for r in kpi.answer(df, share).collect()] == [("c", 90.0)]


def test_shares_of_the_filtered_part(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), ("y", 3)], "s string, k int")
    got = kpi.answer(df, kpi.read("percentage of total count(*)", "s = 'x'")).first()
    assert tuple(got) == (2, 50.0)


def test_names():
    assert names.resolve("department name", {"Department": "dept"}) == "dept" and names.resolve("weather", {"Department": "dept"}) is None
    assert names.resolve_group("departement", {"Name": "Name"}, {"departments": "Name"}) == "Name" and names.resolve_group("zzz", {"Name": "Name"}) is None
    for bad in ("a; b", "a -- b", "drop table x", "'open", "a /* b */"):
        with pytest.raises(names.Unsafe):
            names.safe_text(bad)
    assert names.safe_text("status = 'drop; it'") and not names.sensitive("created_at") and names.category("Policy Number") == "health_plan_beneficiary"


def test_a_share_cannot_be_unsafe(spark):
    df = spark.range(3).select(F.col("id").alias("x"))
    with pytest.raises(names.Unsafe):
        kpi.answer(df, kpi.Kpi((kpi.Measure("sum", "x; drop table y"),)))


def test_quotas_are_exact_at_any_size(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("s"))
    for fraction in (0.001, 0.1, 0.5, 1.0):
        counted = {r["s"]: r["n"] for r in sampling.quotas(df, ["s"], "k", fraction).groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert counted == {k: max(1, round(n * fraction)) for k, n in ((0, 1667), (1, 1667), (2, 1666))}
    assert sampling.quotas(df.limit(0), ["s"], "k", 0.1).count() == 0


def test_decisions_and_tiers():
    assert evidence.holds({"a": 1, "b": {"lt": 3}}, {"a": 1}) == (None, ["b"]) and evidence.holds({"a": 2, "b": {"lt": 3}}, {"a": 1}) == (False, [])
    assert quality.tier([]) == "bronze" and quality.topology({}, []) == "unknown" and quality.arrival([]) == "unknown"


def test_grid_shows_no_sensitive_columns(spark):
    df = spark.createDataFrame([("Ann", "x@y", 3)], "name string, email string, n int")
    rows, total = semantic.grid(df, {"filterModel": {"email": {"type": "equals", "filter": "no"}}})
    assert rows.columns == ["n"] and total.first()["rows"] == 1


UNDERSTOOD = {
    "with at least 1,000 orders": {"having": (">=", 1000.0)}, "at most 3 rows": {"having": ("<=", 3.0)}, "having fewer than ten orders": {"having": ("<", 10.0)}, "with no more than 2.5 points": {"having": ("<=", 2.5)},
    "under 40 orders": {"having": ("<", 40.0)}, "with between 2 and 1,200 orders": {"having": (">=", 2.0), "also": ("<=", 1200.0)}, "more than 3 orders and at most 9 orders": {"having": (">", 3.0), "also": ("<=", 9.0)},
    "top five": {"top": 5}, "top 7 regions": {"top": 7}, "bottom 3": {"top": 3, "lowest": True}, "the lowest": {"top": 20, "lowest": True}, "the most orders": {"top": 20},
    "older than 65 with at least 3 patients": {"having": (">=", 3.0), "filters": ("year(DATE '2024-01-31') - year(born) > 65",)}, "between 20 and 30 years": {"filters": ("year(DATE '2024-01-31') - year(born) >= 20", "year(DATE '2024-01-31') - year(born) <= 30")},
    "over the last 3 months": {"filters": ("cast(d AS date) > add_months(DATE '2024-01-31', -3)", "cast(d AS date) <= DATE '2024-01-31'")}, "in the past two weeks": {"filters": ("cast(d AS date) > date_sub(DATE '2024-01-31', 14)", "cast(d AS date) <= DATE '2024-01-31'")},
}
REFUSED = ["per fortnight", "hourly", "the last month", "top regions", "the bottom", "more than 1 order, more than 2 orders and more than 3 orders"]


@pytest.mark.parametrize("said", UNDERSTOOD)
def test_bounds_ranks_and_periods(said):
    got, want = kpi.read("count(*)", "region, Age(born)", said, as_of="2024-01-31", time_column="d"), UNDERSTOOD[said]
    assert {k: getattr(got, k) for k in ("having", "also", "top", "lowest", "filters")} == {"having": None, "also": None, "top": None, "lowest": False, "filters": ()} | want


@pytest.mark.parametrize("said", REFUSED)
def test_what_is_not_understood_is_refused(said):
    with pytest.raises(kpi.Ambiguous):
        kpi.read("count(*)", "region, Age(born)", said, as_of="2024-01-31", time_column="d")


def test_lists_of_values(spark):
    got = kpi.read("sum(x)", "g in ('a', b), k not in (1, 2), region")
    assert got.filters == ("g IN ('a', 'b')", "k NOT IN (1, 2)") and [d.name for d in got.dims] == ["region"]
    df = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "g string, x int")
    assert sorted(r.x for r in kpi.slicer(df, {"g": ["a", None]}).collect()) == [1, 2]


def test_lowest_and_upper_bounds(spark):
    df = spark.createDataFrame([("a", 5), ("b", 1), ("c", 9), ("d", 3)], "g string, x int")
    assert [tuple(r) for r in kpi.answer(df, kpi.read("sum(x)", "g", "bottom two")).collect()] == [("b", 1), ("d", 3)]
    assert sorted(r.g for r in kpi.answer(df, kpi.read("sum(x)", "g", "with between 3 and 5 points")).collect()) == ["a", "d"]


def test_null_and_other_are_categories(spark):
    df = spark.createDataFrame([(None, 50), ("Other", 40), ("a", 3), ("b", 2)], "g string, x int")
    assert {tuple(r) for r in kpi.cap_categories(df, "g", "x", 2).collect()} == {(None, 50), ("Other", 40), ("All other", 5)}
    assert {tuple(r) for r in kpi.cap_categories(df, "g", "x", 1).collect()} == {(None, 50), ("Other", 45)}


def test_surrogate_keys_do_not_collide(spark):
    from lumenmart.functions import columns as c

    rows = [("a", None, "b"), ("a", "b", None), ("a|b", "c", ""), ("a", "b|c", ""), (None, "-", "x"), ("-", None, "x"), ("a", "", "b")]
    assert spark.createDataFrame(rows, "x string, y string, z string").select(c.surrogate_key(F.col("x"), F.col("y"), F.col("z")).alias("k")).distinct().count() == len(rows)


def test_every_cited_name_is_personal():
    want = {
        "subscriber_name": "name", "guarantor_name": "name", "policy_holder_name": "name", "card_verification_code": "card_verification", "card_expiry_date": "card_expiry", "track_data": "card_track_data", "magstripe": "card_track_data",
        "cid": "card_verification", "aba_code": "bank_account", "swift_code": "bank_account", "subscriber_id": "health_plan_beneficiary", "retina_id": "biometric", "DateOfBirth": "date_of_birth", "metadata.patient.SSN": "ssn",
        "visits[].mrn": "medical_record_number", "expiry_date": None, "department_name": None, "name": None, "admission_date": None,
    }
    assert {n: names.category(n) for n in want} == want
    assert [names.category(n, t) for n in ("name", "AdmissionDate") for t in ("s3/patients.csv", "departments")] == ["name", None, "individual_linked_date", None]


def test_names_of_keys_and_dates(spark):
    from pyspark.sql import types as T

    schema = T._parse_datatype_string("customer_id long, order_id long, modified_at timestamp, created_at timestamp, row_version long")
    assert names.own_key(schema, "orders") == ["order_id"] and not names.own_key(schema, "lines") and names.natural_key(["customerId", "orderId"], "order") == "orderId"
    assert names.changed_at(["created_at", "updated_at"]) == "updated_at" and names.mark_column(schema) == "modified_at" and names.mark_column(T._parse_datatype_string("id long, row_version long")) == "row_version"
    assert names.temporal_anchor("revenue by ShipDate", [("orders", "OrderDate"), ("orders", "ShipDate")]) == ("orders", "ShipDate") and names.temporal_anchor("revenue", [("orders", "orderdate"), ("customer", "born")]) is None
    assert names.term_score("order_date", "when it was ordered", [], ["order", "date"]) == 0.95 and names.velocity(600, True) == "available_now"


def test_rules_on_what_is_known():
    rules = [("stream", {"latency": {"lt": 60}, "files": {"gte": 10}}), ("batch", {"any_of": [{"kind": {"in": ["db", "csv"]}}, {"size": {"gt": 5}}], "owner": {"ne": ""}})]
    assert evidence.decide(rules, {"latency": 5, "files": 20}) == ("stream", []) and evidence.decide(rules, {"latency": 5}) == (None, ["files"])
    assert evidence.decide(rules, {"latency": 99, "kind": "db", "owner": "x"}) == ("batch", []) and evidence.decide(rules, {"latency": 99, "size": 9, "owner": "x"}) == ("batch", [])
    assert evidence.decide(rules, {"latency": 99, "kind": "api", "size": 1, "owner": "x"}) == (None, [])


def test_scores_of_samples():
    assert sampling.score({"distribution": 0.05, "fill": 0.01, "numeric": 0.02, "relationship": 0.1, "target": 0.04, "tail": 0.3, "model": None}) == (
        round(100 * (1 - (0.2 * 0.05 + 0.1 * 0.01 + 0.15 * 0.02 + 0.15 * 0.1 + 0.2 * 0.04 + 0.1 * 0.3) / 0.9), 2), "increase_pct_or_candidates",
    )
    assert sampling.score({"distribution": 0.02, "fill": 0.01}) == (round(100 * (1 - (0.2 * 0.02 + 0.1 * 0.01) / 0.3), 2), "use_current_sample") and sampling.score({"model": 0.4}) == (60.0, "sample_not_model_ready")
