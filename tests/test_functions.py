import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tenora.functions.binning import group_by_edges
from tenora.functions.rates import guarded_corr, percent_where, status_rate
from tenora.functions.text import joined_flags, sanitize_header, sentinel_to_null, yes_no_flag
from tenora.operators.aggregate import (
    churn_and_retention,
    correlation_matrix,
    group_stats,
    mode_with_share,
    null_counts,
    top_k,
    value_shares,
)
from tenora.operators.bins import Bins, bin_dimension, bins_by_status, with_bins
from tenora.operators import quantiles
from tenora.operators.quantiles import exact_percentiles
from tenora.operators.reshape import crosstab, transpose, unstack
from tenora.plans.cohorts import TENURE_EDGES, TENURE_LABELS, with_ratios


def test_bins_are_right_closed_with_the_lowest_edge_inside(spark):
    df = spark.createDataFrame([(v,) for v in (0, 19, 20, 21, 40, 41, 60, None)], "v int")
    got = {r["v"]: (r["b_ordinal"], r["b"]) for r in with_bins(df, {"b": Bins("v", 20)}).collect()}
    assert got == {
        0: (0, "0-19"), 19: (0, "0-19"), 20: (0, "0-19"), 21: (1, "20-39"), 40: (1, "20-39"),
        41: (2, "40-59"), 60: (2, "40-59"), None: (None, None),
    }


def test_values_outside_given_bounds_have_no_bin(spark):
    df = spark.createDataFrame([(-1,), (0,), (5,), (11,)], "v int")
    got = {r["v"]: r["b_ordinal"] for r in with_bins(df, {"b": Bins("v", 5, 0, 10)}).collect()}
    assert got == {-1: None, 0: 0, 5: 0, 11: None}


def test_negative_and_fractional_values_bin(spark):
    df = spark.createDataFrame([(-3.5,), (-1.0,), (2.25,)], "v double")
    got = {r["v"]: (r["b_ordinal"], r["b"]) for r in with_bins(df, {"b": Bins("v", 10)}).collect()}
    assert got == {-3.5: (0, "-10--1"), -1.0: (0, "-10--1"), 2.25: (1, "0-9")}


def test_edge_groups_leave_the_lowest_edge_out(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 12, 13, 72, 73)], "v int")
    g = group_by_edges(F.col("v"), TENURE_EDGES, TENURE_LABELS)
    got = {r["v"]: r["label"] for r in df.select("v", g["label"].alias("label")).collect()}
    assert got == {0: None, 1: "0-12", 12: "0-12", 13: "13-24", 72: "61-72", 73: None}


def test_empty_bins_are_listed(spark, rows):
    data = [(1, "Churned"), (2, "Stayed"), (30, "Churned"), (31, "Joined"), (70, "Stayed"), (71, "Churned"), (100, "Joined")]
    df = spark.createDataFrame(data, "score int, status string")
    got = rows(bins_by_status(df, Bins("score", 20, 0, 100), "status", ["Churned", "Joined", "Stayed"]), "ordinal")
    assert [r["label"] for r in got] == ["0-19", "20-39", "40-59", "60-79", "80-99"]
    assert [(r["Churned"], r["Joined"], r["Stayed"]) for r in got] == [
        (1, 0, 1), (1, 1, 0), (0, 0, 0), (1, 0, 1), (0, 1, 0)]
    assert bin_dimension(df.filter("false"), Bins("score", 20)).count() == 0


def test_rates_with_and_without_denominator(spark):
    df = spark.createDataFrame([("a", "Churned"), ("a", None), ("a", "Stayed"), ("b", "Joined")], "g string, s string")
    got = {r["g"]: r for r in df.groupBy("g").agg(
        percent_where(F.col("s") == "Churned").alias("pct"),
        status_rate("s", "Churned", ["Churned", "Stayed"]).alias("rate"),
    ).collect()}
    assert math.isclose(got["a"]["pct"], 100 / 3) and got["a"]["rate"] == 0.5
    assert got["b"]["pct"] == 0.0 and got["b"]["rate"] is None
    only = churn_and_retention(df.filter("g = 'b'"), "s").first()
    assert only["churn_rate"] is None and only["retention_rate"] is None


def test_ratios_on_zero_are_null(spark):
    df = spark.createDataFrame(
        [(0, 0.0, 1.0, 1.0), (2, 10.0, 1.0, 4.0)],
        "Tenure_in_Months int, Total_Revenue double, Total_Extra_Data_Charges double, Total_Long_Distance_Charges double")
    got = with_ratios(df).orderBy("Tenure_in_Months").collect()
    assert got[0]["Revenue_Per_Month"] is None and got[0]["Extra_Charges_Pct"] is None
    assert got[1]["Revenue_Per_Month"] == 5.0 and got[1]["Extra_Charges_Pct"] == 50.0


def test_correlation_of_constant_single_and_incomplete_groups(spark):
    data = [("const", 1.0, 5.0), ("const", 2.0, 5.0), ("one", 1.0, 2.0), ("gap", 1.0, 2.0), ("gap", 2.0, 4.0), ("gap", 9.0, None)]
    df = spark.createDataFrame(data, "g string, a double, b double")
    got = {r["g"]: r["r"] for r in df.groupBy("g").agg(guarded_corr("a", "b").alias("r")).collect()}
    assert got["const"] is None and got["one"] is None and math.isclose(got["gap"], 1.0)
    matrix = {(r["x"], r["y"]): r["r"] for r in correlation_matrix(df.filter("g = 'const'"), ["a", "b"]).collect()}
    assert matrix == {("a", "a"): 1.0, ("a", "b"): None, ("b", "a"): None, ("b", "b"): None}


def test_crosstab_ignores_null_labels_and_fills_absent_cells(spark, rows):
    data = [("x", "p"), ("x", "p"), ("x", "q"), ("y", "q"), (None, "p"), ("y", None)]
    df = spark.createDataFrame(data, "i string, c string")
    got = rows(crosstab(df, "i", "c"), "i")
    assert [r["i"] for r in got] == ["x", "y"]
    assert math.isclose(got[0]["pct_p"], 200 / 3) and got[1]["pct_p"] == 0.0 and got[1]["pct_q"] == 100.0
    for mode, total in (("columns", 200.0), ("all", 100.0)):
        cells = rows(crosstab(df, "i", "c", ["p", "q"], normalize=mode))
        assert math.isclose(sum(r["pct_p"] + r["pct_q"] for r in cells), total)


def test_unstack_keeps_absent_cells_null_and_transpose_swaps(spark, rows):
    long = spark.createDataFrame([("x", "p", 1.0), ("x", "q", 2.0), ("y", "p", 3.0)], "i string, c string, v double")
    wide = unstack(long, ["i"], "c", "v")
    assert rows(wide, "i") == [{"i": "x", "p": 1.0, "q": 2.0}, {"i": "y", "p": 3.0, "q": None}]
    assert rows(transpose(wide, "i"), "column") == [
        {"column": "p", "x": 1.0, "y": 3.0}, {"column": "q", "x": 2.0, "y": None}]


def test_shares_modes_and_ties(spark, rows):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "v string")
    assert math.isclose(sum(r["pct"] for r in rows(value_shares(df, "v"))), 100.0)
    assert rows(mode_with_share(df, "v")) == [{"top": "a", "top_n": 2, "top_pct": 40.0}]
    ranked = top_k(spark.createDataFrame([(1, 5), (2, 7), (3, 5), (4, 5)], "id int, m int"), "m", 3, ["id"])
    assert [r["id"] for r in ranked.collect()] == [2, 1, 3]


def test_single_row_group_has_no_deviation(spark):
    got = group_stats(spark.createDataFrame([("a", 2.0)], "g string, v double"), ["g"], {"v": ["mean", "median", "std"]}).first()
    assert got["v_mean"] == 2.0 and got["v_median"] == 2.0 and got["v_std"] is None


def test_text_helpers(spark, rows):
    assert sanitize_header("  Monthly Charge ") == "Monthly_Charge"
    df = spark.createDataFrame([("NULL", "Yes"), ("NA", "Male"), ("None", None), ("", "No"), (None, "yes"), ("x", "Yes")], "a string, b string")
    got = df.select(sentinel_to_null(F.col("a")).alias("a"), yes_no_flag(F.col("b")).alias("b")).collect()
    assert [r["a"] for r in got] == [None, None, None, "", None, "x"]
    assert [r["b"] for r in got] == [1, 1, 0, 0, 0, 1]
    flags = spark.createDataFrame([(0, 0), (1, 1), (0, 1)], "movies int, music int")
    combos = flags.select(joined_flags({"music": "SMU", "movies": "SMV"}).alias("c")).collect()
    assert [r["c"] for r in combos] == ["", "SMU + SMV", "SMU"]


def test_null_counts(spark, rows):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b string")
    assert rows(null_counts(df), "column") == [{"column": "a", "nulls": 1}, {"column": "b", "nulls": 2}]


def _expected(values, p):
    s = sorted(values)
    pos = p * (len(s) - 1)
    lo = math.floor(pos)
    return s[lo] + (s[math.ceil(pos)] - s[lo]) * (pos - lo)


@pytest.mark.parametrize("accuracy", [100, 10_000])
@pytest.mark.parametrize("few_groups", [True, False])
def test_percentiles_are_exact_below_and_above_the_sketch_size(spark, accuracy, few_groups):
    rng = random.Random(7)
    data = [("hot", rng.gauss(0, 100)) for _ in range(6000)] + [("tied", float(i % 3)) for i in range(3000)]
    data += [("pair", 1.0), ("pair", 2.0), ("one", 9.0), ("none", None), (None, 5.0)]
    df = spark.createDataFrame(data, "g string, v double").repartition(8)
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}
    got = {r["g"]: r for r in exact_percentiles(df, ["v"], probs, ["g"], accuracy, few_groups).collect()}
    for g in ("hot", "tied", "pair", "one"):
        values = [v for k, v in data if k == g]
        for s, p in probs.items():
            assert math.isclose(got[g][f"v_{s}"], _expected(values, p), rel_tol=1e-12, abs_tol=1e-12), (g, s)
    assert None not in got and "none" not in got


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_percentiles_property(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_percentiles(df, ["v"], {"q": 0.37}, accuracy=20).first()["v_q"]
    assert math.isclose(got, _expected(values, 0.37), rel_tol=1e-9, abs_tol=1e-9)


def test_any_number_of_groups(spark):
    df = spark.range(5000).select(F.col("id").alias("g"), F.col("id").cast("double").alias("v"))
    for few in (True, False):
        got = exact_percentiles(df, ["v"], {"m": 0.5}, ["g"], few_groups=few)
        assert got.count() == 5000 and got.filter("g <> v_m").isEmpty()


@pytest.mark.parametrize("two_passes", [0, 5_000_000])
def test_percentiles_of_ordered_and_uneven_values(spark, monkeypatch, two_passes):
    monkeypatch.setattr(quantiles, "TWO_PASSES", two_passes)
    values = [float(i) for i in range(30_000)] + [1e300, -1e300, 1e-300] + [0.5 + i / 1e9 for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in sorted(values)], "v double").repartitionByRange(8, "v")
    probs = {"a": 0.01, "b": 0.05, "c": 0.5, "d": 0.99}
    got = exact_percentiles(df, ["v"], probs, accuracy=50).first()
    assert all(math.isclose(got[f"v_{s}"], _expected(values, p), rel_tol=1e-12) for s, p in probs.items())
    groups = spark.range(9000).selectExpr("id % 3 as g", "cast(id * id % 1000 as double) as v", "cast(null as double) as w")
    groups = groups.unionByName(spark.createDataFrame([(0, float("nan"), None), (9, 4.0, 1.0)], "g long, v double, w double"))
    for r in exact_percentiles(groups, ["v", "w"], {"m": 0.5, "x": 0.9}, ["g"], accuracy=20).collect():
        own = [float(i * i % 1000) for i in range(9000) if i % 3 == r.g] if r.g < 9 else [4.0]
        assert (r.v_m, r.v_x) == (_expected(own, 0.5), _expected(own, 0.9)) and r.w_m == (None if r.g < 9 else 1.0)


def test_unstack_raises_on_a_label_that_is_not_listed(spark):
    long = spark.createDataFrame([(1, "F", 50.0), (1, "Z", 50.0), (2, None, 1.0)], "i int, c string, v double")
    assert unstack(long, ["i"], "c", "v", ["F", "Z"]).columns == ["i", "F", "Z"]
    assert unstack(long, ["i"], "c", "v", ["F", "Z"]).count() == 2
    with pytest.raises(Exception, match="not listed: Z"):
        unstack(long, ["i"], "c", "v", ["F"]).collect()
