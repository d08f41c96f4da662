"""One wide customer row per customer, derived from the order and line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenora.operators.lookup import sorted_categories
from tenora.session import shared_table

# The part type whose presence in the last order switches a service on.
SERVICE_BY_PART_TYPE = {
    "Online_Security": "ECONOMY",
    "Online_Backup": "LARGE",
    "Device_Protection_Plan": "MEDIUM",
    "Premium_Tech_Support": "PROMO",
    "Streaming_TV": "SMALL",
    "Streaming_Movies": "STANDARD",
}
# Column order of the wide customer row.
WIDE_COLUMNS = [
    "Customer_ID", "Gender", "Age", "Under_30", "Senior_Citizen", "Married", "Dependents",
    "Number_of_Dependents", "Country", "State", "City", "Zip_Code", "Latitude", "Longitude",
    "Population", "Quarter", "Referred_a_Friend", "Number_of_Referrals", "Tenure_in_Months", "Offer",
    "Phone_Service", "Avg_Monthly_Long_Distance_Charges", "Multiple_Lines", "Internet_Service",
    "Internet_Type", "Avg_Monthly_GB_Download", "Online_Security", "Online_Backup",
    "Device_Protection_Plan", "Premium_Tech_Support", "Streaming_TV", "Streaming_Movies",
    "Streaming_Music", "Unlimited_Data", "Contract", "Paperless_Billing", "Payment_Method",
    "Monthly_Charge", "Total_Charges", "Total_Extra_Data_Charges", "Total_Long_Distance_Charges",
    "Total_Revenue", "Satisfaction_Score", "Customer_Status", "Churn_Label", "Churn_Score", "CLTV",
    "Churn_Category", "Churn_Reason", "Cluster",
]
# Wide columns stored as Yes/No (Gender as Male/Female) in the raw file.
FLAG_COLUMNS = [
    "Under_30", "Senior_Citizen", "Married", "Dependents", "Referred_a_Friend", "Phone_Service",
    "Multiple_Lines", "Internet_Service", "Online_Security", "Online_Backup", "Device_Protection_Plan",
    "Premium_Tech_Support", "Streaming_TV", "Streaming_Movies", "Streaming_Music", "Unlimited_Data",
    "Paperless_Billing", "Churn_Label",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _units(c: Column, scale: int) -> Column:
    """Exact sum of a fixed-point amount in whole units of ``1/scale``.

    Whole numbers add up the same in any row order and stay in long arithmetic, several times faster than
    wide decimals. Prices have cents (scale 100), price times rate has four digits (scale 10000).
    """
    return F.sum(F.round(c * scale).cast("long"))


def _flag(c: Column) -> Column:
    return F.coalesce(c.cast("int"), F.lit(0))


def _months(later: Column, earlier: Column) -> Column:
    return (F.year(later) * 12 + F.month(later)) - (F.year(earlier) * 12 + F.month(earlier))


def customer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lazy wide profile.

    Lines are summed per order before they meet the orders, and only the lines of each customer's last
    order are joined to the parts. Every aggregate has a map-side stage, so a customer, order or part that
    holds a large share of the lines never lands in one task; the line-to-part join keeps its skew
    handling because the aggregate after it is on another key.
    """
    customer, orders = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "orders")
    lines, part = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "part")
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")

    order_day = F.col("o_orderdate").cast("date")
    by_customer = orders.groupBy("o_custkey").agg(
        F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus", "o_orderpriority")).alias("last"),
        F.min(order_day).alias("first_day"),
        (_units(F.col("o_totalprice"), 100) / 100.0).alias("revenue"),
    )
    line_sums = (
        lines.groupBy("l_orderkey")
        .agg(
            _units(F.col("l_extendedprice"), 100).alias("charges"),
            _units(F.col("l_extendedprice") * F.col("l_tax"), 10_000).alias("extra_data"),
            _units(F.col("l_extendedprice") * F.col("l_discount"), 10_000).alias("long_distance"),
            _units(F.col("l_quantity"), 100).alias("quantity"),
        )
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("line_custkey"))
        .agg(*[
            (F.sum(c) / scale).alias(c)
            for c, scale in (("charges", 100.0), ("extra_data", 1e4), ("long_distance", 1e4), ("quantity", 100.0))
        ])
    )
    last_orders = by_customer.select(
        F.col("o_custkey").alias("last_custkey"), F.col("last.o_orderkey").alias("last_orderkey")
    )
    last_lines = (
        lines.select("l_orderkey", "l_partkey", "l_returnflag", "l_quantity")
        .join(last_orders, F.col("l_orderkey") == F.col("last_orderkey"))
        .join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("last_custkey")
        .agg(
            F.max("l_returnflag").alias("max_flag"),
            F.min("p_type").alias("min_type"),
            F.count(F.lit(1)).alias("n_lines"),
            F.max("l_quantity").alias("max_quantity"),
            *[
                F.max((F.col("p_type") == kind).cast("int")).alias(service)
                for service, kind in SERVICE_BY_PART_TYPE.items()
            ],
        )
    )
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "n_name", "r_name"
    )
    first_of_all = orders.select(F.min(order_day)).scalar()
    last_of_all = orders.select(F.max(order_day)).scalar()
    segments = sorted_categories(customer, "c_mktsegment")

    key, nationkey = F.col("c_custkey"), F.col("c_nationkey")
    last_day = F.col("last.o_orderdate").cast("date")
    tenure = F.coalesce(_months(last_day, F.col("first_day")), F.lit(0)).cast("int")
    months = F.greatest(F.col("Tenure_in_Months"), F.lit(1))
    money = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("charges", "extra_data", "long_distance")}
    churned = F.col("Customer_Status") == "Churned"
    return (
        customer.join(by_customer, key == F.col("o_custkey"), "left")
        .join(line_sums, key == F.col("line_custkey"), "left")
        .join(last_lines, key == F.col("last_custkey"), "left")
        .join(places, nationkey == F.col("n_nationkey"), "left")
        .withColumns({
            "Customer_ID": key,
            "Gender": (key % 2).cast("int"),
            "Age": (18 + key % 63).cast("int"),
            "Married": (key % 5 < 2).cast("int"),
            "Number_of_Dependents": (key % 7 % 4).cast("int"),
            "Number_of_Referrals": (key * 7 % 12).cast("int"),
            "Country": F.lit("World"),
            "State": F.col("r_name"),
            "City": F.col("n_name"),
            "Zip_Code": (10000 + nationkey * 100 + key % 10).cast("int"),
            "Latitude": (nationkey * 1.5 - 20).cast("double"),
            "Longitude": (nationkey * 3.25 - 40).cast("double"),
            "Population": ((nationkey + 1) * 1000 + key % 10 * 700).cast("int"),
            "Quarter": F.lit("Q3"),
            "Tenure_in_Months": tenure,
            "Offer": F.col("last.o_orderpriority"),
            "Contract": F.col("last.o_orderstatus"),
            "Payment_Method": F.col("max_flag"),
            "Internet_Type": F.col("min_type"),
            "Phone_Service": _flag(F.col("max_quantity") >= 25),
            "Multiple_Lines": _flag(F.col("n_lines") > 1),
            "Internet_Service": _flag(F.col("n_lines") > 0),
            "Streaming_Music": _flag(F.col("max_flag") == "R"),
            "Unlimited_Data": _flag(F.col("max_quantity") >= 45),
            **{service: _flag(F.col(service)) for service in SERVICE_BY_PART_TYPE},
            "Paperless_Billing": (key % 3 != 0).cast("int"),
            "Total_Revenue": F.coalesce("revenue", F.lit(0.0)),
            "Total_Charges": money["charges"],
            "Total_Extra_Data_Charges": money["extra_data"],
            "Total_Long_Distance_Charges": money["long_distance"],
            "Satisfaction_Score": F.least(
                F.lit(5), F.floor((F.col("c_acctbal") + 1000) / 2200) + 1
            ).cast("int"),
            "CLTV": F.floor(F.col("c_acctbal") + 1000).cast("int"),
            "Customer_Status": F.when(last_day.isNull(), "Joined")
            .when(last_day < F.date_sub(last_of_all, 180), "Churned")
            .when(F.col("first_day") >= F.date_add(first_of_all, 365), "Joined")
            .otherwise("Stayed"),
            "Churn_Score": F.coalesce(
                F.least(F.lit(100), F.floor(F.datediff(last_of_all, last_day) / 10)), F.lit(0)
            ).cast("int"),
            "Cluster": (F.array_position(segments, F.col("c_mktsegment")) - 1).cast("int"),
        })
        .withColumns({
            "Under_30": (F.col("Age") < 30).cast("int"),
            "Senior_Citizen": (F.col("Age") >= 65).cast("int"),
            "Dependents": (F.col("Number_of_Dependents") > 0).cast("int"),
            "Referred_a_Friend": (F.col("Number_of_Referrals") > 0).cast("int"),
            "Monthly_Charge": F.col("Total_Revenue") / months,
            "Avg_Monthly_Long_Distance_Charges": F.col("Total_Long_Distance_Charges") / months,
            "Avg_Monthly_GB_Download": F.coalesce("quantity", F.lit(0.0)) / months,
            "Churn_Label": churned.cast("int"),
            "Churn_Category": F.when(churned, F.col("Offer")),
            "Churn_Reason": F.when(churned, F.col("Internet_Type")),
        })
        .select(*WIDE_COLUMNS)
    )


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile as a table written once per application, laid out by cluster for partition pruning."""
    return shared_table(
        spark, "profile", sf_dir, lambda: customer_profile(spark, sf_dir), partition_by="Cluster"
    ).select(*WIDE_COLUMNS)


def raw_customers(wide: DataFrame) -> DataFrame:
    """The profile as the raw file has it: Yes/No and Male/Female text, and no cluster."""
    return wide.withColumns({
        "Gender": F.when(F.col("Gender") == 1, "Male").otherwise("Female"),
        **{c: F.when(F.col(c) == 1, "Yes").otherwise("No") for c in FLAG_COLUMNS},
    }).drop("Cluster")
