from pyspark.sql import functions as F

from tenora.operators.select import replace_sentinels, sample_exact, sample_rows, with_row_id
from tenora.plans.profile import customer_profile, profile
from tenora.session import shared_table

SF = "/root/testdata/sf0.001"


def test_row_ids_are_unique_and_samples_keep_keys(spark):
    df = spark.range(1000).repartition(5)
    assert with_row_id(df).select("row_id").distinct().count() == 1000
    assert sample_rows(df, 1.0) is df
    part = sample_rows(df, 0.3, 42)
    assert 200 < part.count() < 400 and part.join(df, "id", "left_anti").count() == 0
    other = sample_rows(df.repartition(3), 0.3, 42, ["id"])  # the same rows in any partitioning
    assert part.exceptAll(other).count() == 0 and other.exceptAll(part).count() == 0


def test_exact_samples(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as g").repartition(5)
    part = sample_exact(df, 0.25, 1)
    assert part.count() == 250 and part.columns == ["id", "g"]
    other = sample_exact(df.repartition(3).withColumn("x", F.lit(1)), 0.25, 1, ["id", "g"]).drop("x")
    assert part.exceptAll(other).count() == 0
    assert part.exceptAll(sample_exact(df, 0.25, 2)).count() > 0
    tied = spark.createDataFrame([(1,)] * 50 + [(2,)] * 50, "k int")  # equal keys have equal hashes
    assert sample_exact(tied, 0.31).count() == 31
    assert [sample_exact(df, f).count() for f in (0.0, 1.0)] == [0, 1000] and sample_exact(df.limit(0), 0.5).count() == 0


def test_row_ids_are_consecutive(spark):
    df = with_row_id(spark.range(1000).repartition(5))
    assert sorted(r.row_id for r in df.collect()) == list(range(1, 1001)) and df.collect() == df.collect()


def test_sentinels_only_touch_text_columns(spark):
    df = spark.createDataFrame([("NA", 1), ("x", 2)], "a string, b int")
    got = replace_sentinels(df).orderBy("b").collect()
    assert [r["a"] for r in got] == [None, "x"] and df.schema == replace_sentinels(df).schema


def test_stored_profile_equals_the_lazy_one(spark):
    lazy, stored = customer_profile(spark, SF), profile(spark, SF)
    assert lazy.exceptAll(stored).count() == 0 and stored.exceptAll(lazy).count() == 0


def test_profile_has_one_row_per_customer_for_customers_without_orders(spark, tmp_path):
    for name in ("customer", "orders", "lineitem", "part", "nation", "region"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "orders":
            df = df.filter(F.col("o_custkey") != 1)
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    wide = customer_profile(spark, str(tmp_path))
    row = wide.filter("Customer_ID = 1").collect()
    assert len(row) == 1 and row[0]["Customer_Status"] == "Joined" and row[0]["Total_Revenue"] == 0.0
    assert row[0]["Contract"] is None and row[0]["Tenure_in_Months"] == 0


def test_unused_joins_leave_the_plan(spark):
    plan = customer_profile(spark, SF).groupBy("Cluster").agg(F.avg("Age"))._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan


def test_shared_table_is_written_once_and_refreshed_on_request(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    for refresh, rows in ((False, 1), (False, 1), (True, 2)):
        assert shared_table(spark, "counted", "here", build, refresh=refresh).count() == rows
    assert len(calls) == 2


def test_frames_from_before_two_refreshes_stay_readable(spark):
    frames = [shared_table(spark, "kept", "here", lambda n=n: spark.range(n), refresh=True) for n in (1, 2, 3)]
    assert [f.count() for f in frames] == [1, 2, 3]
