"""Wide customer rows to keyed lookup and customer tables, and back."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenora.operators.keys import dense_ids, keep_ids
from tenora.operators.merge import distinct_members, insert_missing, lookup, update_by_key, upsert
from tenora.operators.quality import Check, violations

# Lookup tables as (id, {target column: wide column} of the key, attributes).
LOOKUPS: dict[str, tuple[str, dict[str, str], dict[str, str]]] = {
    "Locations": (
        "LocationID",
        {"Country": "Country", "State": "State", "City": "City", "ZipCode": "Zip_Code"},
        {"Population": "Population", "Latitude": "Latitude", "Longitude": "Longitude"},
    ),
    "PaymentMethods": ("PaymentMethodID", {"PaymentMethodName": "Payment_Method"}, {}),
    "ContractTypes": ("ContractTypeID", {"ContractTypeName": "Contract"}, {}),
    "ChurnReasons": ("ChurnReasonID", {"ChurnReason": "Churn_Reason"}, {}),
    "InternetServices": ("InternetServiceID", {"InternetServiceType": "Internet_Type"}, {}),
}
LOOKUP_SCHEMAS = {
    "Locations": "LocationID int, Country string, State string, City string, ZipCode string, Population int, "
    "Latitude decimal(9,6), Longitude decimal(9,6)",
    "PaymentMethods": "PaymentMethodID int, PaymentMethodName string",
    "ContractTypes": "ContractTypeID int, ContractTypeName string",
    "ChurnReasons": "ChurnReasonID int, ChurnReason string",
    "InternetServices": "InternetServiceID int, InternetServiceType string",
    "Clusters": "ClusterID int, Description string",
}


def empty_lookup(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], LOOKUP_SCHEMAS[name])


def staged(wide: DataFrame) -> DataFrame:
    """Wide rows with the types of the normalised schema (zip as text, coordinates as decimals)."""
    return wide.withColumns({
        "Zip_Code": F.col("Zip_Code").cast("string"),
        "Latitude": F.col("Latitude").cast("decimal(9,6)"),
        "Longitude": F.col("Longitude").cast("decimal(9,6)"),
    })


def build_lookup(wide: DataFrame, name: str, current: DataFrame | None = None) -> DataFrame:
    """Merge the distinct members of ``wide`` into ``current`` (empty when not given); ids never change."""
    id_column, keys, attributes = LOOKUPS[name]
    target = current if current is not None else empty_lookup(wide.sparkSession, name)
    members = distinct_members(staged(wide), keys, attributes)
    first = next(iter(keys))
    if name == "ChurnReasons":
        members = members.filter(F.col(first) != "")
    return insert_missing(target, members, list(keys), id_column)


def build_clusters(wide: DataFrame, current: DataFrame | None = None) -> DataFrame:
    target = current if current is not None else empty_lookup(wide.sparkSession, "Clusters")
    found = wide.select(F.col("Cluster").cast("int").alias("ClusterID")).na.drop().distinct()
    described = found.withColumn("Description", F.concat(F.lit("Cluster "), F.col("ClusterID").cast("string")))
    return upsert(target, described, ["ClusterID"])


def _bit(c: str) -> F.Column:
    return F.col(c).cast("boolean")


def customer_info(wide: DataFrame, locations: DataFrame, clusters: DataFrame, how: str = "left") -> DataFrame:
    keys = LOOKUPS["Locations"][1]
    rows = lookup(staged(wide), locations, {w: t for t, w in keys.items()}, ["LocationID"], how)
    rows = lookup(rows, clusters, {"Cluster": "ClusterID"}, ["ClusterID"], how)
    return rows.select(
        F.col("Customer_ID").cast("string").alias("CustomerID"),
        _bit("Gender").alias("Gender"),
        F.col("Age").cast("int").alias("Age"),
        _bit("Senior_Citizen").alias("SeniorCitizen"),
        _bit("Under_30").alias("UnderThirty"),
        _bit("Married").alias("Married"),
        _bit("Dependents").alias("Dependents"),
        F.coalesce(F.col("Number_of_Dependents").cast("int"), F.lit(0)).alias("NumberOfDependents"),
        _bit("Referred_a_Friend").alias("ReferredAFriend"),
        F.coalesce(F.col("Number_of_Referrals").cast("int"), F.lit(0)).alias("NumberOfReferrals"),
        "LocationID",
        F.col("Customer_Status").alias("Status"),
        F.col("Satisfaction_Score").cast("int").alias("SatisfactionScore"),
        F.col("CLTV").cast("int").alias("CLTV"),
        "ClusterID",
    )


def customer_services(wide: DataFrame, internet: DataFrame, how: str = "left") -> DataFrame:
    """``how='inner'`` drops customers without an internet type."""
    rows = lookup(wide, internet, {"Internet_Type": "InternetServiceType"}, ["InternetServiceID"], how)
    flags = {
        "PhoneService": "Phone_Service", "MultipleLines": "Multiple_Lines", "OnlineSecurity": "Online_Security",
        "OnlineBackup": "Online_Backup", "DeviceProtection": "Device_Protection_Plan",
        "PremiumTechSupport": "Premium_Tech_Support", "StreamingTV": "Streaming_TV",
        "StreamingMovies": "Streaming_Movies", "StreamingMusic": "Streaming_Music",
        "UnlimitedData": "Unlimited_Data",
    }
    return rows.select(
        F.col("Customer_ID").cast("string").alias("CustomerID"),
        "InternetServiceID",
        *[_bit(w).alias(t) for t, w in flags.items()],
    )


def customer_churn_history(wide: DataFrame, reasons: DataFrame) -> DataFrame:
    rows = lookup(wide, reasons, {"Churn_Reason": "ChurnReason"}, ["ChurnReasonID"])
    return rows.select(
        F.col("Customer_ID").cast("string").alias("CustomerID"),
        _bit("Churn_Label").alias("ChurnLabel"),
        F.col("Churn_Category").alias("ChurnCategory"),
        "ChurnReasonID",
        F.col("Churn_Score").cast("int").alias("ChurnScore"),
    )


def customer_billing(wide: DataFrame) -> DataFrame:
    money = {
        "MonthlyCharges": "Monthly_Charge", "TotalCharges": "Total_Charges",
        "TotalExtraDataCharges": "Total_Extra_Data_Charges",
        "TotalLongDistanceCharges": "Total_Long_Distance_Charges", "TotalRevenue": "Total_Revenue",
    }
    return wide.select(
        F.col("Customer_ID").cast("string").alias("CustomerID"),
        *[F.col(w).cast("decimal(10,2)").alias(t) for t, w in money.items()],
    )


def customer_contract(
    wide: DataFrame, contracts: DataFrame, methods: DataFrame, how: str = "left"
) -> DataFrame:
    rows = lookup(wide, contracts, {"Contract": "ContractTypeName"}, ["ContractTypeID"], how)
    rows = lookup(rows, methods, {"Payment_Method": "PaymentMethodName"}, ["PaymentMethodID"], how)
    return rows.select(
        F.col("Customer_ID").cast("string").alias("CustomerID"),
        "ContractTypeID",
        F.col("Offer").alias("OfferType"),
        _bit("Paperless_Billing").alias("PaperlessBilling"),
        "PaymentMethodID",
        F.col("Tenure_in_Months").cast("int").alias("TenureInMonths"),
    )


# Identity columns of the customer tables.
FACT_IDS = {
    "CustomerServices": "CustomerServiceID",
    "CustomerContract": "CustomerContractID",
    "CustomerBilling": "BillingID",
    "CustomerChurnHistory": "ChurnID",
}


def normalize(
    wide: DataFrame,
    current: Mapping[str, DataFrame] | None = None,
    how: str = "left",
    with_ids: bool = True,
    store: Callable[[str, DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """All eleven tables. ``current`` holds tables of an earlier load, lookup or customer tables, whose ids are kept.

    ``store(name, table)`` may write each lookup table and return it read back; the customer tables then
    join the stored lookups instead of deriving them again from the wide rows.
    """
    current = current or {}
    t = {name: build_lookup(wide, name, current.get(name)) for name in LOOKUPS}
    t["Clusters"] = build_clusters(wide, current.get("Clusters"))
    if store is not None:
        t = {name: store(name, table) for name, table in t.items()}
    t["CustomerInfo"] = customer_info(wide, t["Locations"], t["Clusters"], how)
    t["CustomerServices"] = customer_services(wide, t["InternetServices"], how)
    t["CustomerChurnHistory"] = customer_churn_history(wide, t["ChurnReasons"])
    t["CustomerBilling"] = customer_billing(wide)
    t["CustomerContract"] = customer_contract(wide, t["ContractTypes"], t["PaymentMethods"], how)
    if with_ids:
        for name, id_column in FACT_IDS.items():
            before = current.get(name)
            t[name] = dense_ids(t[name], ["CustomerID"], id_column) if before is None else keep_ids(before, t[name], ["CustomerID"], id_column)
    return t


def assign_clusters(info: DataFrame, segments: DataFrame, key: str = "Customer_ID") -> DataFrame:
    """Write new cluster numbers onto the customer table by key; customers not listed keep theirs."""
    changes = segments.select(
        F.col(key).cast("string").alias("CustomerID"), F.col("Cluster").cast("int").alias("ClusterID")
    )
    return update_by_key(info, changes, ["CustomerID"])


def denormalize(t: Mapping[str, DataFrame]) -> DataFrame:
    """Join all tables back to one wide row per customer."""
    info = t["CustomerInfo"].join(t["Locations"], "LocationID", "left")
    services = t["CustomerServices"].join(t["InternetServices"], "InternetServiceID", "left")
    contract = (
        t["CustomerContract"]
        .join(t["ContractTypes"], "ContractTypeID", "left")
        .join(t["PaymentMethods"], "PaymentMethodID", "left")
    )
    churn = t["CustomerChurnHistory"].join(t["ChurnReasons"], "ChurnReasonID", "left")
    wide = info
    for part in (services, contract, t["CustomerBilling"], churn):
        wide = wide.join(part, "CustomerID", "left")
    return wide.select(
        F.col("CustomerID").alias("Customer_ID"),
        F.col("Gender").cast("int").alias("Gender"),
        "Age",
        F.col("UnderThirty").cast("int").alias("Under_30"),
        F.col("SeniorCitizen").cast("int").alias("Senior_Citizen"),
        F.col("Married").cast("int").alias("Married"),
        F.col("Dependents").cast("int").alias("Dependents"),
        F.col("NumberOfDependents").alias("Number_of_Dependents"),
        "Country", "State", "City",
        F.col("ZipCode").alias("Zip_Code"),
        "Latitude", "Longitude", "Population",
        F.col("ReferredAFriend").cast("int").alias("Referred_a_Friend"),
        F.col("NumberOfReferrals").alias("Number_of_Referrals"),
        F.col("TenureInMonths").alias("Tenure_in_Months"),
        F.col("OfferType").alias("Offer"),
        F.col("PhoneService").cast("int").alias("Phone_Service"),
        F.col("MultipleLines").cast("int").alias("Multiple_Lines"),
        F.col("InternetServiceType").alias("Internet_Type"),
        F.col("OnlineSecurity").cast("int").alias("Online_Security"),
        F.col("OnlineBackup").cast("int").alias("Online_Backup"),
        F.col("DeviceProtection").cast("int").alias("Device_Protection_Plan"),
        F.col("PremiumTechSupport").cast("int").alias("Premium_Tech_Support"),
        F.col("StreamingTV").cast("int").alias("Streaming_TV"),
        F.col("StreamingMovies").cast("int").alias("Streaming_Movies"),
        F.col("StreamingMusic").cast("int").alias("Streaming_Music"),
        F.col("UnlimitedData").cast("int").alias("Unlimited_Data"),
        F.col("ContractTypeName").alias("Contract"),
        F.col("PaperlessBilling").cast("int").alias("Paperless_Billing"),
        F.col("PaymentMethodName").alias("Payment_Method"),
        F.col("MonthlyCharges").alias("Monthly_Charge"),
        F.col("TotalCharges").alias("Total_Charges"),
        F.col("TotalExtraDataCharges").alias("Total_Extra_Data_Charges"),
        F.col("TotalLongDistanceCharges").alias("Total_Long_Distance_Charges"),
        F.col("TotalRevenue").alias("Total_Revenue"),
        F.col("SatisfactionScore").alias("Satisfaction_Score"),
        F.col("Status").alias("Customer_Status"),
        F.col("ChurnLabel").cast("int").alias("Churn_Label"),
        F.col("ChurnScore").alias("Churn_Score"),
        "CLTV",
        F.col("ChurnCategory").alias("Churn_Category"),
        F.col("ChurnReason").alias("Churn_Reason"),
        F.col("ClusterID").alias("Cluster"),
    )


# Value rules, unique keys and references of the normalised schema.
CHECKS = {
    "CustomerInfo": [
        Check("status", "Status IN ('Churned', 'Stayed', 'Joined')"),
        Check("satisfaction", "SatisfactionScore BETWEEN 1 AND 5"),
    ],
    "CustomerChurnHistory": [Check("churn_score", "ChurnScore BETWEEN 0 AND 100")],
}
UNIQUE = {
    "CustomerInfo": "CustomerID",
    "InternetServices": "InternetServiceType",
    "ContractTypes": "ContractTypeName",
    "PaymentMethods": "PaymentMethodName",
    "ChurnReasons": "ChurnReason",
}
REFERENCES = [
    ("CustomerInfo", "LocationID", "Locations"),
    ("CustomerInfo", "ClusterID", "Clusters"),
    ("CustomerServices", "CustomerID", "CustomerInfo"),
    ("CustomerServices", "InternetServiceID", "InternetServices"),
    ("CustomerContract", "CustomerID", "CustomerInfo"),
    ("CustomerContract", "ContractTypeID", "ContractTypes"),
    ("CustomerContract", "PaymentMethodID", "PaymentMethods"),
    ("CustomerBilling", "CustomerID", "CustomerInfo"),
    ("CustomerChurnHistory", "CustomerID", "CustomerInfo"),
    ("CustomerChurnHistory", "ChurnReasonID", "ChurnReasons"),
]


def constraint_violations(t: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rule, key) for every broken value rule, unique key, missing key or reference."""
    return violations(t, CHECKS, UNIQUE, REFERENCES)
