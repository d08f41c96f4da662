"""Single operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenora.catalog.profile_sql import with_profile, with_raw
from tenora.catalog.registry import register
from tenora.catalog.reports import CHURN_PCT, CLUSTERS, PAYMENTS, bin_sql, bounds_sql, corr_sql
from tenora.functions.binning import group_by_edges
from tenora.functions.rates import mean_of, percent_where
from tenora.functions.text import sanitize_header, sentinel_to_null
from tenora.operators import aggregate as A
from tenora.operators import merge as M
from tenora.operators import plotdata as V
from tenora.operators import quality as Q
from tenora.operators import reshape as R
from tenora.operators import select as S
from tenora.operators.bins import Bins, with_bins
from tenora.operators.quantiles import exact_percentiles
from tenora.plans import exploration as X
from tenora.plans.profile import FLAG_COLUMNS, WIDE_COLUMNS, profile, raw_customers, read_table
from tenora.sources.landing import split_cells
from tenora.operators.keys import keep_ids, numbered
from tenora.sources.query import fetch

NUMERIC = [c for c in WIDE_COLUMNS if c not in (
    "Customer_ID", "Zip_Code", "Country", "State", "City", "Quarter", "Offer", "Internet_Type", "Contract",
    "Payment_Method", "Customer_Status", "Churn_Category", "Churn_Reason")]
FLOATS = [
    "Avg_Monthly_Long_Distance_Charges", "Avg_Monthly_GB_Download", "Monthly_Charge", "Total_Charges",
    "Total_Extra_Data_Charges", "Total_Long_Distance_Charges", "Total_Revenue",
]


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


# --- sources, projections and filters -----------------------------------------------------------------

@register("query_source", "S11 P1 P4 L1", (
    "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders "
    "WHERE o_orderstatus = 'F' GROUP BY o_orderpriority"))
def _(spark, sf):
    return fetch(
        spark,
        "SELECT o_orderpriority, count(*) AS n, round(sum(cast(o_totalprice AS decimal(18,2))), 2) AS total "
        "FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_orderpriority",
        orders=read_table(spark, sf, "orders"),
    ).withColumn("total", F.col("total").cast("double"))


@register("rename_and_drop", "P2 P3 S5 F7", "SELECT c_custkey AS customer_key, c_name AS Customer_Name, "
          "c_acctbal AS balance FROM customer")
def _(spark, sf):
    df = read_table(spark, sf, "customer").drop("c_nationkey", "c_mktsegment")
    spaced = df.withColumnsRenamed({"c_custkey": "customer_key", "c_name": " Customer Name ", "absent": "x"})
    return spaced.toDF(*[sanitize_header(c) for c in spaced.columns]).withColumnRenamed("c_acctbal", "balance")


@register("sentinels_to_null", "P7 A22", with_profile(
    "SELECT CASE WHEN Offer IN ('NULL', 'NA', 'None', '5-LOW') THEN NULL ELSE Offer END AS Offer, count(*) AS n "
    "FROM profile GROUP BY 1"))
def _(spark, sf):
    words = ("NULL", "NA", "None", "5-LOW")
    offer = sentinel_to_null(F.col("Offer"), words)
    return profile(spark, sf).groupBy(offer.alias("Offer")).agg(F.count(F.lit(1)).alias("n"))


@register("listwise_complete_rows", "P8 P10", with_profile(
    "SELECT Customer_ID, Churn_Reason, Payment_Method FROM profile WHERE Churn_Reason IS NOT NULL "
    "AND Churn_Reason <> '' AND Payment_Method IS NOT NULL"))
def _(spark, sf):
    rows = profile(spark, sf).select("Customer_ID", "Churn_Reason", "Payment_Method")
    return rows.na.drop(subset=["Churn_Reason", "Payment_Method"]).filter(F.col("Churn_Reason") != "")


@register("columns_by_type", "P11 U4", with_profile(_union(
    f"SELECT '{c}' AS \"column\", '{k}' AS kind" for k, cs in (
        ("text", ["Country", "State", "City", "Quarter", "Offer", "Internet_Type", "Contract", "Payment_Method",
                  "Customer_Status", "Churn_Category", "Churn_Reason"]),
        ("int", [c for c in WIDE_COLUMNS if c not in FLOATS + [
            "Latitude", "Longitude", "Country", "State", "City", "Quarter", "Offer", "Internet_Type", "Contract",
            "Payment_Method", "Customer_Status", "Churn_Category", "Churn_Reason"]]),
        ("float", ["Latitude", "Longitude", *FLOATS]),
    ) for c in cs)))
def _(spark, sf):
    df = profile(spark, sf)
    pairs = [(c, k) for k in ("text", "int", "float") for c in S.columns_of(df, k)]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind")) for c, k in pairs])
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.explode(cells).alias("x")).select("x.*")


@register("constant_columns_dropped", "P13", with_profile("SELECT Customer_ID, State, City, Contract FROM profile"))
def _(spark, sf):
    df = profile(spark, sf).select("Customer_ID", "Country", "State", "City", "Quarter", "Contract")
    return S.drop_constant_columns(df)


@register("high_cardinality_dropped", "P14", "SELECT c_mktsegment, c_custkey FROM customer")
def _(spark, sf):
    df = read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return df.drop(*S.high_cardinality_columns(df, keep=["c_custkey"]))


@register("distinct_value_counts", "A10 Q3", _union(
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(DISTINCT {c}) AS n_distinct FROM orders"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
def _(spark, sf):
    return S.distinct_counts(read_table(spark, sf, "orders"))


@register("derived_ratios", "P15 F13", with_profile(
    "SELECT Customer_ID, round(Total_Revenue / nullif(Tenure_in_Months, 0), 6) AS Revenue_Per_Month, "
    "round((Total_Extra_Data_Charges + Total_Long_Distance_Charges) / nullif(Total_Revenue, 0) * 100, 6) "
    "AS Extra_Charges_Pct FROM profile"))
def _(spark, sf):
    from tenora.plans.cohorts import with_ratios

    return with_ratios(profile(spark, sf)).select("Customer_ID", "Revenue_Per_Month", "Extra_Charges_Pct")


@register("casts", "P16 F2 F3 F4", with_profile(
    "SELECT CAST(Zip_Code AS VARCHAR) AS zip, left(City, 6) AS city_start, length(City) AS city_length, "
    "TRY_CAST(Contract AS INT) AS contract_number, coalesce(TRY_CAST(left(Offer, 1) AS SMALLINT), 0) AS offer_number, "
    "count(*) AS n FROM profile GROUP BY ALL"))
def _(spark, sf):
    return profile(spark, sf).groupBy(
        F.col("Zip_Code").cast("string").alias("zip"),
        F.left("City", F.lit(6)).alias("city_start"),
        F.length("City").alias("city_length"),
        F.col("Contract").try_cast("int").alias("contract_number"),
        F.coalesce(F.left("Offer", F.lit(1)).try_cast("smallint"), F.lit(0)).alias("offer_number"),
    ).agg(F.count(F.lit(1)).alias("n"))


@register("text_functions", "F1 F3", (
    "SELECT p_partkey, trim(replace(p_name, ' ', '_')) AS name, p_brand || '/' || p_type AS kind, "
    "length(p_name) AS n_chars, left(p_brand, 5) AS brand FROM part"))
def _(spark, sf):
    return read_table(spark, sf, "part").select(
        "p_partkey",
        F.trim(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"),
        F.concat("p_brand", F.lit("/"), "p_type").alias("kind"),
        F.length("p_name").alias("n_chars"),
        F.left("p_brand", F.lit(5)).alias("brand"),
    )


@register("half_even_rounding", "F9", (
    "SELECT l_returnflag, l_linestatus, CAST(round_even(avg(l_quantity), 2) AS DOUBLE) AS quantity, count(*) AS n "
    "FROM lineitem GROUP BY l_returnflag, l_linestatus"))
def _(spark, sf):
    return read_table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.bround(F.avg("l_quantity"), 2).alias("quantity"), F.count(F.lit(1)).alias("n")
    )


# --- aggregations -------------------------------------------------------------------------------------

@register("event_type_counts", "A1 A11", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    return A.value_counts(read_table(spark, sf, "events"), "event_type")


@register("event_type_share_per_user", "A12 A13", (
    "SELECT user_id, event_type, count(*) AS n, "
    "round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS pct FROM events "
    "GROUP BY user_id, event_type"))
def _(spark, sf):
    return A.value_shares(read_table(spark, sf, "events"), "event_type", ["user_id"])


@register("mode_per_user", "A15", (
    "SELECT user_id, event_type AS top, n AS top_n, round(100.0 * n / total, 6) AS top_pct FROM ("
    "SELECT user_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS total, "
    "row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events "
    "GROUP BY user_id, event_type) WHERE rn = 1"))
def _(spark, sf):
    return A.mode_with_share(read_table(spark, sf, "events"), "event_type", ["user_id"])


@register("line_statistics", "A4 A5 A6 A7 A8", (
    "SELECT l_returnflag, round(avg(l_extendedprice), 6) AS l_extendedprice_mean, "
    "round(median(l_extendedprice), 6) AS l_extendedprice_median, "
    "round(stddev_samp(l_extendedprice), 6) AS l_extendedprice_std, round(avg(l_quantity), 6) AS l_quantity_mean, "
    "min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max, sum(l_quantity) AS l_quantity_sum "
    "FROM lineitem GROUP BY l_returnflag"))
def _(spark, sf):
    return A.group_stats(read_table(spark, sf, "lineitem"), ["l_returnflag"], {
        "l_extendedprice": ["mean", "median", "std"], "l_quantity": ["mean", "min", "max", "sum"],
    })


@register("order_price_percentiles", "A4", (
    "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.1), 6) AS o_totalprice_p10, "
    "round(quantile_cont(o_totalprice, 0.5), 6) AS o_totalprice_p50, "
    "round(quantile_cont(o_totalprice, 0.99), 6) AS o_totalprice_p99 FROM orders GROUP BY o_orderpriority"))
def _(spark, sf):
    return exact_percentiles(
        read_table(spark, sf, "orders"), ["o_totalprice"], {"p10": 0.1, "p50": 0.5, "p99": 0.99}, ["o_orderpriority"]
    )


@register("median_order_per_customer", "A4", (
    "SELECT o_custkey, round(median(o_totalprice), 6) AS o_totalprice_median FROM orders GROUP BY o_custkey"))
def _(spark, sf):
    return exact_percentiles(
        read_table(spark, sf, "orders"), ["o_totalprice"], {"median": 0.5}, ["o_custkey"], few_groups=False
    )


@register("conditional_rates", "A2 A3", (
    "SELECT o_orderpriority, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS filled_pct, "
    "round(avg(o_totalprice), 6) AS price_avg FROM orders GROUP BY o_orderpriority"))
def _(spark, sf):
    return read_table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        percent_where(F.col("o_orderstatus") == "F").alias("filled_pct"), mean_of("o_totalprice").alias("price_avg")
    )


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("line_correlation_by_flag", "A16 A17", _union(
    f"SELECT l_returnflag, '{a}' AS x, '{b}' AS y, {corr_sql(a, b)} AS r FROM lineitem GROUP BY l_returnflag"
    for a in _LINE for b in _LINE))
def _(spark, sf):
    return A.correlation_matrix(read_table(spark, sf, "lineitem"), _LINE, ["l_returnflag"])


@register("null_counts_per_column", "A22 V7", with_profile(_union(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM profile" for c in WIDE_COLUMNS)))
def _(spark, sf):
    return A.null_counts(profile(spark, sf))


@register("registry_names", "A21 U1", "SELECT string_agg(p_type, ', ' ORDER BY p_type) AS names "
          "FROM (SELECT DISTINCT p_type FROM part)")
def _(spark, sf):
    return A.text_list(read_table(spark, sf, "part"), "p_type")


# --- reshape ------------------------------------------------------------------------------------------

@register("crosstab_all_and_columns", "X1 X5", with_profile(_union(
    f"SELECT '{mode}' AS mode, Contract, Payment_Method, count(*) AS n, "
    f"round(100.0 * count(*) / sum(count(*)) OVER ({over}), 6) AS pct FROM profile "
    "WHERE Contract IS NOT NULL AND Payment_Method IS NOT NULL GROUP BY Contract, Payment_Method"
    for mode, over in (("index", "PARTITION BY Contract"), ("columns", "PARTITION BY Payment_Method"), ("all", "")))))
def _(spark, sf):
    df = profile(spark, sf)
    parts = [
        R.crosstab_long(df, "Contract", "Payment_Method", mode).withColumn("mode", F.lit(mode))
        for mode in ("index", "columns", "all")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("unstack_without_fill", "X2 X8", with_profile("SELECT Offer, " + ", ".join(
    f'nullif(count(*) FILTER (WHERE Payment_Method = \'{p}\' AND Cluster = 1 AND Customer_Status = \'Stayed\'), 0) AS "n_{p}"'
    for p in PAYMENTS) + " FROM profile WHERE Offer IS NOT NULL AND Payment_Method IS NOT NULL AND Cluster = 1 "
    "AND Customer_Status = 'Stayed' GROUP BY Offer"))
def _(spark, sf):
    rows = profile(spark, sf).filter((F.col("Cluster") == 1) & (F.col("Customer_Status") == "Stayed"))
    counts = A.value_counts(rows, "Payment_Method", ["Offer"])
    return R.unstack(counts, ["Offer"], "Payment_Method", "n", PAYMENTS, prefix="n_")


@register("melted_flags", "X4", with_profile(_union(
    f"SELECT Customer_ID, '{c}' AS Service, {c} AS Value FROM profile" for c in FLAG_COLUMNS)))
def _(spark, sf):
    return R.melt(profile(spark, sf), ["Customer_ID"], FLAG_COLUMNS, ("Service", "Value"))


@register("transposed_means", "X7", with_profile(_union(
    f"SELECT '{c}' AS \"column\", " + ", ".join(
        f"round(avg({c}) FILTER (WHERE Cluster = {k}), 6) AS cluster_{k}" for k in CLUSTERS) + " FROM profile"
    for c in ("Age", "CLTV", "Churn_Score"))))
def _(spark, sf):
    means = profile(spark, sf).groupBy("Cluster").agg(*[mean_of(c).alias(c) for c in ("Age", "CLTV", "Churn_Score")])
    return R.transpose(means, "Cluster", prefix="cluster_", labels=CLUSTERS)


# --- sort, limit, set operations, joins ---------------------------------------------------------------

@register("largest_orders", "L2 L3 L4", (
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"))
def _(spark, sf):
    rows = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return A.top_k(rows, "o_totalprice", 25, ["o_orderkey"])


@register("distinct_locations", "U1", with_profile(
    "SELECT DISTINCT Country, State, City, Zip_Code, Population, Latitude, Longitude FROM profile"))
def _(spark, sf):
    return profile(spark, sf).select(
        "Country", "State", "City", "Zip_Code", "Population", "Latitude", "Longitude").distinct()


@register("duplicate_rows_removed", "U2 A23 Q7", "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def _(spark, sf):
    return read_table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority").dropDuplicates()


@register("duplicate_row_count", "A23 Q7", (
    "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders)) "
    "AS duplicates FROM orders"))
def _(spark, sf):
    return Q.duplicate_count(read_table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"))


@register("duplicate_rows_listed", "A23", (
    "SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS copies FROM orders GROUP BY ALL HAVING count(*) > 1"))
def _(spark, sf):
    return Q.duplicate_rows(read_table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"))


@register("duplicate_columns_removed", "U3", "SELECT c_custkey, c_name FROM customer")
def _(spark, sf):
    c = read_table(spark, sf, "customer").select("c_custkey", "c_name")
    return S.dedupe_columns(c.toDF("c_custkey", "c_name").select("c_custkey", "c_name", F.upper("c_name").alias("c_name")))


@register("appended_rows", "U5", (
    "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier "
    "UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer"))
def _(spark, sf):
    s = read_table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = read_table(spark, sf, "customer").select(
        F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    return M.append_rows(s, c)


@register("lookup_inner", "J1 J2 J3", (
    "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey"))
def _(spark, sf):
    c = read_table(spark, sf, "customer")
    c = M.lookup(c, read_table(spark, sf, "nation"), {"c_nationkey": "n_nationkey"}, ["n_name", "n_regionkey"], "inner")
    c = M.lookup(c, read_table(spark, sf, "region"), {"n_regionkey": "r_regionkey"}, ["r_name"], "inner")
    return c.select("c_custkey", "n_name", "r_name")


@register("lookup_left", "J4", (
    "SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') "
    "ON o_custkey = c_custkey"))
def _(spark, sf):
    building = read_table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    return M.lookup(read_table(spark, sf, "orders"), building, {"o_custkey": "c_custkey"}, ["c_name"]).select(
        "o_orderkey", "c_name")


@register("null_crosscheck", "J7 Q6 V7", with_raw(
    ", a AS (" + _union(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS table_nulls, "
        f"count(*) FILTER (WHERE {c} IS NULL OR Customer_Status = 'Joined') AS file_nulls FROM raw_customers"
        for c in WIDE_COLUMNS if c != "Cluster") +
    ") SELECT * FROM a WHERE table_nulls > 0 AND file_nulls > 0"))
def _(spark, sf):
    raw = raw_customers(profile(spark, sf))
    blanked = raw.select(*[F.when(F.col("Customer_Status") != "Joined", F.col(c)).alias(c) for c in raw.columns])
    return Q.null_crosscheck(raw, blanked, ("table_nulls", "file_nulls"))


@register("merge_insert_only", "J8 N2", (
    "SELECT row_number() OVER (ORDER BY p_brand) AS id, p_brand AS name FROM ("
    "SELECT DISTINCT p_brand FROM part WHERE p_size <= 10) UNION ALL "
    "SELECT (SELECT count(DISTINCT p_brand) FROM part WHERE p_size <= 10) + row_number() OVER (ORDER BY p_brand), p_brand "
    "FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size <= 10))"))
def _(spark, sf):
    part = read_table(spark, sf, "part")
    empty = spark.createDataFrame([], "id int, name string")
    first = M.insert_missing(
        empty, M.distinct_members(part.filter(F.col("p_size") <= 10), {"name": "p_brand"}), ["name"], "id")
    both = M.insert_missing(first, M.distinct_members(part, {"name": "p_brand"}), ["name"], "id")
    return both


@register("row_ids", "P17", (
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS row_id FROM orders"))
def _(spark, sf):
    orders = read_table(spark, sf, "orders")
    order = [F.col("o_orderpriority").asc(), F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]
    return numbered(spark, orders, order).select("o_orderkey", "row_id")


@register("sampled_rows", "P18 M18", (
    "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY substr(md5('42 ' || CAST(o_orderkey AS VARCHAR)), 1, 15), "
    "o_orderkey) AS place FROM orders) WHERE place <= (SELECT round(0.3 * count(*)) FROM orders)"))
def _(spark, sf):
    return S.sample_exact(read_table(spark, sf, "orders"), 0.3, 42, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@register("ids_after_reload", "N2 N5", (
    "WITH f AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS id FROM customer WHERE c_custkey % 10 <> 3) "
    "SELECT c_custkey, id FROM f UNION ALL SELECT c_custkey, (SELECT count(*) FROM f) + row_number() OVER (ORDER BY c_custkey) "
    "FROM customer WHERE c_custkey % 10 = 3"))
def _(spark, sf):
    customers = read_table(spark, sf, "customer").select("c_custkey")
    first = keep_ids(None, customers.filter("c_custkey % 10 <> 3"), ["c_custkey"], "id")
    return keep_ids(first, customers, ["c_custkey"], "id").select("c_custkey", "id")


@register("merge_upsert", "J9", (
    "SELECT coalesce(s.s_suppkey, c.c_custkey) AS id, CASE WHEN c.c_custkey IS NOT NULL THEN c.c_name ELSE s.s_name END "
    "AS name, CASE WHEN c.c_custkey IS NOT NULL THEN c.c_acctbal ELSE s.s_acctbal END AS balance "
    "FROM supplier s FULL JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c ON s_suppkey = c_custkey"))
def _(spark, sf):
    target = read_table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    source = read_table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return M.upsert(target, source, ["id"])


@register("keyed_update", "J10 J6", (
    "SELECT c.c_custkey, c_name, CASE WHEN o_custkey IS NOT NULL THEN total ELSE c_acctbal END AS c_acctbal "
    "FROM customer c LEFT JOIN (SELECT o_custkey, CAST(max(o_totalprice) AS DOUBLE) AS total FROM orders "
    "WHERE o_orderstatus = 'P' GROUP BY o_custkey) ON o_custkey = c_custkey"))
def _(spark, sf):
    changes = read_table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P").groupBy(
        F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    target = read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return M.update_by_key(target, changes, ["c_custkey"])


@register("semi_join", "J11 S3", (
    "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey "
    "AND o_orderpriority = '1-URGENT')"))
def _(spark, sf):
    urgent = read_table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    return M.exists_in(
        read_table(spark, sf, "customer"), urgent.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]
    ).select("c_custkey", "c_name")


@register("split_to_rows", "J12", (
    "SELECT p_partkey, unnest(range(len(w))) AS pos, unnest(w) AS cell FROM ("
    "SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)"))
def _(spark, sf):
    return split_cells(read_table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", " ")


@register("orphan_rows", "J13 N10", (
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer "
    "WHERE c_mktsegment <> 'MACHINERY')"))
def _(spark, sf):
    parents = read_table(spark, sf, "customer").filter(F.col("c_mktsegment") != "MACHINERY")
    return M.orphans(read_table(spark, sf, "orders"), "o_custkey", parents, "c_custkey").select("o_orderkey", "o_custkey")


@register("cascade_delete", "J13", (
    "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer "
    "WHERE c_mktsegment = 'MACHINERY') GROUP BY o_custkey"))
def _(spark, sf):
    gone = read_table(spark, sf, "customer").filter(F.col("c_mktsegment") == "MACHINERY")
    kept = M.cascade_delete(read_table(spark, sf, "orders"), "o_custkey", gone, "c_custkey")
    return kept.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@register("cascade_update", "J13", (
    "SELECT s_suppkey, s_nationkey + 100 * CAST(n_regionkey = 1 AS INT) AS s_nationkey FROM supplier "
    "JOIN nation ON s_nationkey = n_nationkey"))
def _(spark, sf):
    moved = read_table(spark, sf, "nation").filter(F.col("n_regionkey") == 1).select(
        "n_nationkey", (F.col("n_nationkey") + 100).alias("new_key"))
    rows = read_table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return M.cascade_update(rows, "s_nationkey", moved, "n_nationkey", "new_key")


# --- binning ------------------------------------------------------------------------------------------

_price_ord, _price_lab = bin_sql("p_retailprice", 50, "lo", "hi")


@register("price_bins", "B1 F6 F12", (
    "WITH b AS (SELECT CAST(floor(min(p_retailprice) / 50) * 50 AS BIGINT) AS lo, "
    "CAST(ceil(max(p_retailprice) / 50) * 50 AS BIGINT) AS hi FROM part) "
    f"SELECT {_price_ord} AS price_ordinal, {_price_lab} AS price, count(*) AS n FROM part, b GROUP BY 1, 2"))
def _(spark, sf):
    binned = with_bins(read_table(spark, sf, "part").select("p_retailprice"), {"price": Bins("p_retailprice", 50)})
    return binned.groupBy("price_ordinal", "price").agg(F.count(F.lit(1)).alias("n"))


@register("quantity_edges", "B2", (
    "SELECT CASE WHEN l_quantity > 1 AND l_quantity <= 10 THEN 0 WHEN l_quantity > 10 AND l_quantity <= 25 THEN 1 "
    "WHEN l_quantity > 25 AND l_quantity <= 40 THEN 2 END AS ordinal, count(*) AS n FROM lineitem GROUP BY 1"))
def _(spark, sf):
    group = group_by_edges(F.col("l_quantity"), [1, 10, 25, 40], ["2-10", "11-25", "26-40"])
    return read_table(spark, sf, "lineitem").groupBy(group["ordinal"].alias("ordinal")).agg(F.count(F.lit(1)).alias("n"))


# --- quality ------------------------------------------------------------------------------------------

_TEXT = [c for c in WIDE_COLUMNS if c not in (*NUMERIC, "Customer_ID", "Zip_Code")]


@register("describe_text", "Q1", with_profile(_union(
    f"SELECT * FROM (SELECT '{c}' AS \"column\", sum(n) OVER () AS \"count\", count(*) OVER () AS \"unique\", v AS top, "
    f"n AS freq FROM (SELECT {c} AS v, count(*) AS n FROM profile WHERE {c} IS NOT NULL GROUP BY {c}) "
    "ORDER BY n DESC, v LIMIT 1)" for c in _TEXT)))
def _(spark, sf):
    return Q.describe_text(profile(spark, sf))


def _describe_sql(columns, where="TRUE") -> str:
    return with_profile(_union(
        f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", round(avg({c}), 6) AS mean, "
        f"round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min, "
        f"round(CAST(max({c}) AS DOUBLE), 6) AS max, round(quantile_cont({c}, 0.25), 6) AS q25, "
        f"round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75 "
        f"FROM profile WHERE {where}" for c in columns))


@register("describe_numeric", "Q2", _describe_sql(NUMERIC))
def _(spark, sf):
    return Q.describe_numeric(profile(spark, sf).select(*NUMERIC))


_NO_PLACE = [c for c in NUMERIC if c not in ("Latitude", "Longitude")]


@register("describe_churned", "Q5 P2 P4", _describe_sql(_NO_PLACE, "Customer_Status = 'Churned'"))
def _(spark, sf):
    return Q.describe_numeric(X.churned_only(profile(spark, sf)).select(*_NO_PLACE))


@register("dataset_shape", "Q4", with_profile(
    f"SELECT count(*) AS rows, {len(WIDE_COLUMNS)} AS columns, "
    "'Country, State, City, Quarter, Offer, Internet_Type, Contract, Payment_Method, Customer_Status, Churn_Category, "
    "Churn_Reason' AS text_columns, '" + ", ".join(c for c in WIDE_COLUMNS if c not in (
        "Country", "State", "City", "Quarter", "Offer", "Internet_Type", "Contract", "Payment_Method",
        "Customer_Status", "Churn_Category", "Churn_Reason")) + "' AS numeric_columns FROM profile"))
def _(spark, sf):
    return Q.dataset_shape(profile(spark, sf))


@register("binary_candidates", "Q3", with_raw(_union(
    f"SELECT '{c}' AS \"column\" FROM raw_customers HAVING count(DISTINCT {c}) = 2"
    for c in ["Gender", *FLAG_COLUMNS, "Country", "State", "City", "Quarter", "Offer", "Internet_Type", "Contract",
              "Payment_Method", "Customer_Status", "Churn_Category", "Churn_Reason"])))
def _(spark, sf):
    raw = raw_customers(profile(spark, sf))
    names = F.array(*[F.lit(c) for c in S.binary_text_columns(raw)])
    return raw.agg(F.count(F.lit(1)).alias("n")).select(F.explode(names).alias("column"))


@register("broken_rules", "P19 Q8", with_profile(
    "SELECT 'status' AS rule, CAST(Customer_ID AS VARCHAR) AS key FROM profile "
    "WHERE Customer_Status NOT IN ('Churned', 'Stayed') "
    "UNION ALL SELECT 'satisfaction', CAST(Customer_ID AS VARCHAR) FROM profile WHERE Satisfaction_Score NOT BETWEEN 2 AND 5 "
    "UNION ALL SELECT 'churn_score', CAST(Customer_ID AS VARCHAR) FROM profile WHERE Churn_Score NOT BETWEEN 0 AND 90"))
def _(spark, sf):
    return Q.failed_checks(profile(spark, sf), "Customer_ID", [
        Q.Check("status", "Customer_Status IN ('Churned', 'Stayed')"),
        Q.Check("satisfaction", "Satisfaction_Score BETWEEN 2 AND 5"),
        Q.Check("churn_score", "Churn_Score BETWEEN 0 AND 90"),
    ])


@register("repeated_keys", "Q8", "SELECT o_custkey, count(*) AS copies FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def _(spark, sf):
    return Q.repeated_keys(read_table(spark, sf, "orders"), "o_custkey")


# --- plot data ----------------------------------------------------------------------------------------

def _histogram_sql(columns, bins, source="profile") -> str:
    return _union(
        f"SELECT '{c}' AS \"column\", ordinal, round(lo + ordinal * ((hi - lo) / {bins}), 6) AS low, "
        f"round(lo + (ordinal + 1) * ((hi - lo) / {bins}), 6) AS high, count(*) AS n FROM ("
        f"SELECT lo, hi, CAST(least(floor((x - lo) / ((hi - lo) / {bins})), {bins} - 1) AS INT) AS ordinal FROM ("
        f"SELECT CAST({c} AS DOUBLE) AS x, "
        f"CASE WHEN mx > mn THEN mn ELSE mn - 0.5 END AS lo, CASE WHEN mx > mn THEN mx ELSE mx + 0.5 END AS hi "
        f"FROM {source}, (SELECT CAST(min({c}) AS DOUBLE) AS mn, CAST(max({c}) AS DOUBLE) AS mx FROM {source}) "
        f"WHERE {c} IS NOT NULL)) GROUP BY lo, hi, ordinal"
        for c in columns)


@register("numeric_distributions", "R6 V1", with_profile(_histogram_sql(NUMERIC, 10)))
def _(spark, sf):
    return X.numeric_distributions(profile(spark, sf))


@register("line_histograms", "V1", _histogram_sql(["l_quantity", "l_extendedprice"], 20, "lineitem"))
def _(spark, sf):
    return V.histograms(read_table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], 20)


@register("age_histogram_focus", "V1", with_profile(
    ", f AS (SELECT * FROM profile WHERE Cluster = 1), k AS (SELECT count(DISTINCT Age) AS bins, "
    "CAST(min(Age) AS DOUBLE) AS lo, CAST(max(Age) AS DOUBLE) AS hi FROM f), "
    "o AS (SELECT CAST(least(floor((Age - lo) / ((hi - lo) / bins)), bins - 1) AS INT) AS ordinal, lo, hi, bins FROM f, k) "
    "SELECT 'Age' AS \"column\", ordinal, round(lo + ordinal * ((hi - lo) / bins), 6) AS low, "
    "round(lo + (ordinal + 1) * ((hi - lo) / bins), 6) AS high, count(*) AS n FROM o GROUP BY ordinal, lo, hi, bins"))
def _(spark, sf):
    return V.histogram_by_distinct(profile(spark, sf).filter(F.col("Cluster") == 1), "Age")


def box_sql(columns, by: str | None = None, source: str = "profile", where: str = "TRUE") -> str:
    key, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    on = f"USING ({by})" if by else "ON TRUE"
    known = f"{by} IS NOT NULL AND {where}" if by else where
    return _union(
        f"SELECT {key}'{c}' AS \"column\", count(x) AS n, round(any_value(q1), 6) AS q1, "
        f"round(any_value(med), 6) AS median, round(any_value(q3), 6) AS q3, "
        "round(min(x) FILTER (WHERE x BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5), 6) AS whisker_low, "
        "round(max(x) FILTER (WHERE x BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5), 6) AS whisker_high, "
        "count(*) FILTER (WHERE x NOT BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS outliers FROM ("
        f"SELECT {key}CAST({c} AS DOUBLE) AS x FROM {source} WHERE {known}) JOIN ("
        f"SELECT {key}quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS med, "
        f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {source} WHERE {known}{group}) {on}{group}"
        for c in columns)


@register("numeric_outliers", "R7 V2", with_profile(box_sql(NUMERIC)))
def _(spark, sf):
    return X.numeric_outliers(profile(spark, sf))


@register("charge_boxes_by_cluster", "V2", with_profile(box_sql(["Monthly_Charge"], "Cluster")))
def _(spark, sf):
    return V.box_stats(profile(spark, sf), ["Monthly_Charge"], ["Cluster"])


@register("payment_boxes_focus", "V2", with_profile(
    box_sql(["Total_Charges", "Tenure_in_Months"], "Payment_Method", where="Cluster = 1")))
def _(spark, sf):
    focus = profile(spark, sf).filter(F.col("Cluster") == 1)
    return V.box_stats(focus, ["Total_Charges", "Tenure_in_Months"], ["Payment_Method"])


@register("price_boxes_by_priority", "V2", box_sql(["o_totalprice"], "o_orderpriority", "orders"))
def _(spark, sf):
    return V.box_stats(read_table(spark, sf, "orders"), ["o_totalprice"], ["o_orderpriority"])


@register("tenure_charge_points", "V5", with_profile(
    "SELECT Tenure_in_Months, round(Monthly_Charge, 6) AS Monthly_Charge, Contract FROM profile WHERE Cluster = 1"))
def _(spark, sf):
    focus = profile(spark, sf).filter(F.col("Cluster") == 1)
    return V.scatter_points(focus, ["Tenure_in_Months", "Monthly_Charge", "Contract"])


@register("pair_points", "V5", with_profile("SELECT Churn_Score, CLTV, Cluster, Customer_Status FROM profile"))
def _(spark, sf):
    return V.scatter_points(profile(spark, sf), ["Churn_Score", "CLTV", "Cluster", "Customer_Status"])
