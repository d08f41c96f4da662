"""Merges, keys, quality, normalisation."""

import pytest
from pyspark.sql import functions as F

from tenora.operators import merge as M
from tenora.operators import quality as Q
from tenora.operators import select as S
from tenora.operators.keys import dense_ids
from tenora.plans import normalize as N
from tenora.plans.profile import profile, raw_customers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def wide(spark):
    return profile(spark, SF)


def test_insert_only_merge_is_idempotent_and_keeps_ids(spark, rows):
    empty = spark.createDataFrame([], "id int, name string")
    first = M.insert_missing(empty, spark.createDataFrame([("m",), ("c",)], "name string"), ["name"], "id")
    assert rows(first, "id") == [{"id": 1, "name": "c"}, {"id": 2, "name": "m"}]
    again = M.insert_missing(first, spark.createDataFrame([("m",), ("a",), ("c",)], "name string"), ["name"], "id")
    assert rows(again, "id") == [{"id": 1, "name": "c"}, {"id": 2, "name": "m"}, {"id": 3, "name": "a"}]
    assert M.insert_missing(again, spark.createDataFrame([("m",)], "name string"), ["name"], "id").count() == 3


def test_upsert_and_keyed_update(spark, rows):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, d string")
    source = spark.createDataFrame([(2, None), (3, "c")], "id int, d string")
    assert rows(M.upsert(target, source, ["id"]), "id") == [{"id": 1, "d": "a"}, {"id": 2, "d": None}, {"id": 3, "d": "c"}]
    assert rows(M.update_by_key(target, source, ["id"]), "id") == [{"id": 1, "d": "a"}, {"id": 2, "d": None}]


def test_orphans_and_cascades(spark, rows):
    child = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id int, parent int")
    parent = spark.createDataFrame([(10,)], "pid int")
    assert [r["id"] for r in rows(M.orphans(child, "parent", parent, "pid"))] == [2]
    assert [r["id"] for r in rows(M.cascade_delete(child, "parent", parent, "pid"), "id")] == [2, 3]
    moved = M.cascade_update(child, "parent", spark.createDataFrame([(10, 99)], "o int, n int"), "o", "n")
    assert [r["parent"] for r in rows(moved, "id")] == [99, 20, None]


def test_dimension_members_are_unique_by_key_even_when_attributes_differ(spark, rows):
    df = spark.createDataFrame([("z1", 5), ("z1", 3), ("z2", None), (None, 1)], "zip string, pop int")
    got = rows(M.distinct_members(df, {"ZipCode": "zip"}, {"Population": "pop"}), "ZipCode")
    assert got == [{"ZipCode": "z1", "Population": 3}, {"ZipCode": "z2", "Population": None}]


def test_dense_ids_do_not_depend_on_partitioning(spark):
    df = spark.range(10_000).select((F.col("id") * 7).cast("string").alias("k"))
    a = {r["k"]: r["n"] for r in dense_ids(df, ["k"], "n").collect()}
    b = {r["k"]: r["n"] for r in dense_ids(df.repartition(13), ["k"], "n").collect()}
    assert a == b and sorted(a.values()) == list(range(1, 10_001))


def test_duplicates_in_rows_and_columns(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None), (2, None)], "x int, y string")
    assert rows(Q.duplicate_count(df)) == [{"duplicates": 3}]
    assert rows(Q.duplicate_count(df.dropDuplicates())) == [{"duplicates": 0}]
    twice = df.select("x", "y", F.lit("other").alias("x"))
    assert Q.duplicate_column_count(twice) == 1
    assert S.dedupe_columns(twice).columns == ["x", "y"] and S.dedupe_columns(twice).first()["x"] in (1, 2)


def test_column_selection(spark, wide):
    raw = raw_customers(wide)
    assert set(S.constant_columns(raw)) == {"Country", "Quarter"}
    assert {"Gender", "Married", "Churn_Label"} <= set(S.binary_text_columns(raw))
    keyed = raw.withColumn("Customer_ID", F.col("Customer_ID").cast("string")).withColumn("Copy", F.concat("Customer_ID", F.lit("x")))
    assert S.high_cardinality_columns(keyed, keep=["Customer_ID"]) == ["Copy"]
    text, flags = S.service_columns(wide)
    assert text == ["Internet_Type"] and "Multiple_Lines" not in flags and "Unlimited_Data" in flags
    counts = {r["column"]: r["n_distinct"] for r in S.distinct_counts(spark.createDataFrame([(None,), ("a",)], "v string")).collect()}
    assert counts == {"v": 1}


def test_standardised_columns(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, None, 5.0)], "id int, a double, c double")
    got = S.standardize(df, ["a", "c"]).orderBy("id").collect()
    assert [r["a"] for r in got] == [-1.0, 1.0, None] and {r["c"] for r in got} == {0.0}


def test_normalised_tables_round_trip_and_hold_constraints(spark, wide):
    t = N.normalize(wide)
    assert len(t) == 11
    assert t["CustomerInfo"].count() == t["CustomerBilling"].count() == wide.count()
    assert N.constraint_violations(t).count() == 0
    ids = [r[0] for r in t["CustomerBilling"].select("BillingID").collect()]
    assert sorted(ids) == list(range(1, wide.count() + 1))
    back = N.denormalize(t)
    same = ["Gender", "City", "Population", "Contract", "Payment_Method", "Internet_Type", "Churn_Reason", "Cluster"]
    left = wide.select(F.col("Customer_ID").cast("string"), *same)
    assert left.exceptAll(back.select("Customer_ID", *same)).count() == 0


def test_stored_lookups_give_the_same_tables(spark, wide, tmp_path):
    def store(name, table):
        table.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    lazy, stored = N.normalize(wide), N.normalize(wide, store=store)
    for name in ("Locations", "CustomerInfo", "CustomerContract"):
        assert lazy[name].exceptAll(stored[name]).count() == 0


def test_second_load_keeps_lookup_ids(spark, wide):
    first = N.build_lookup(wide.filter("Contract <> 'F'"), "ContractTypes")
    second = N.build_lookup(wide, "ContractTypes", first)
    kept = {r["ContractTypeName"]: r["ContractTypeID"] for r in first.collect()}
    now = {r["ContractTypeName"]: r["ContractTypeID"] for r in second.collect()}
    assert kept.items() <= now.items() and now["F"] == len(kept) + 1


def test_broken_rules_are_reported(spark):
    t = {
        "A": spark.createDataFrame([("1", 7), ("2", None), ("2", 3)], "CustomerID string, v int"),
        "P": spark.createDataFrame([(3,)], "v int"),
    }
    got = Q.violations(t, {"A": [Q.Check("small", "v < 5")]}, {"A": "CustomerID"}, [("A", "v", "P")]).collect()
    assert sorted((r["rule"], r["key"]) for r in got) == [("reference v", "7"), ("small", "1"), ("unique CustomerID", "2")]


def test_clusters_follow_the_key_whatever_the_row_order(spark, wide):
    info = wide.select(F.col("Customer_ID").cast("string").alias("CustomerID"), F.lit(-1).alias("ClusterID"))
    shuffled = wide.select("Customer_ID", "Cluster").orderBy(F.rand(1)).repartition(7)
    got = {r["CustomerID"]: r["ClusterID"] for r in N.assign_clusters(info, shuffled).collect()}
    assert got == {str(r["Customer_ID"]): r["Cluster"] for r in wide.select("Customer_ID", "Cluster").collect()}


def test_merge_refuses_repeated_keys_and_inserts_null_ones(spark, rows):
    target = spark.createDataFrame([(1, "a"), (None, "z")], "id int, d string")
    twice = spark.createDataFrame([(1, "b"), (1, "c")], "id int, d string")
    with pytest.raises(Exception, match="several rows for 1"):
        M.upsert(target, twice, ["id"]).collect()
    nulls = spark.createDataFrame([(None, "x"), (None, "y"), (2, None)], "id int, d string")
    got = sorted((r.id is None, r.id or 0, r.d or "") for r in M.upsert(target, nulls, ["id"]).collect())
    assert got == [(False, 1, "a"), (False, 2, ""), (True, 0, "x"), (True, 0, "y"), (True, 0, "z")]
    with pytest.raises(Exception, match="several rows for 1"):
        M.cascade_update(target, "id", twice.withColumnRenamed("d", "new"), "id", "new").collect()


def test_ids_survive_a_reload(spark):
    from tenora.operators.keys import keep_ids, numbered

    def read(df):
        return {r.k: r.n for r in df.collect()}

    first = keep_ids(None, spark.createDataFrame([("b",), ("d",)], "k string"), ["k"], "n")
    assert read(first) == {"b": 1, "d": 2}
    second = keep_ids(first, spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string").repartition(3), ["k"], "n")
    assert read(second) == {"b": 1, "d": 2, "a": 3, "c": 4}
    same = spark.range(5000).selectExpr("1 as k", "id").repartition(7)  # one key on all rows still spreads
    ranked = numbered(spark, same, ["k"], "n")
    assert sorted(r.n for r in ranked.collect()) == list(range(1, 5001))
    assert ranked.collect() == ranked.collect()
    assert numbered(spark, spark.createDataFrame([], "k int"), ["k"], "n").count() == 0


def test_any_number_of_categories(spark):
    from tenora.operators.clustering import label_encode, spread_metrics

    rows = spark.range(6000).selectExpr("id", "lpad(cast(id as string), 5, '0') as name").repartition(4)
    got = label_encode(rows.unionByName(spark.createDataFrame([(-1, None)], "id long, name string")), "name", "code")
    assert all(r.code == (r.id if r.id >= 0 else None) for r in got.collect())
    many = spark.range(10_000).selectExpr("id % 5000 as c", "array(cast(id as double)) as v")
    assert spread_metrics(many, "v", "c").first()["clusters"] == 5000
