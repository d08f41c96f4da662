"""Normalised tables, landing files and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenora.catalog.profile_sql import with_profile, with_raw
from tenora.catalog.registry import register
from tenora.plans import normalize as N
from tenora.plans.profile import FLAG_COLUMNS, WIDE_COLUMNS, profile, raw_customers, read_table
from tenora.session import scratch_path, shared_files
from tenora.sources import landing as L
from tenora.sources import sinks as K
from tenora.sources.audit import IMPORT_FAILED, latest_status
from tenora.sources.ledger import ImportLedger, import_new

LOCATIONS = (
    "Locations AS (SELECT row_number() OVER (ORDER BY Country, State, City, ZipCode) AS LocationID, * FROM ("
    "SELECT Country, State, City, CAST(Zip_Code AS VARCHAR) AS ZipCode, min(Population) AS Population, "
    "min(CAST(Latitude AS DECIMAL(9,6))) AS Latitude, min(CAST(Longitude AS DECIMAL(9,6))) AS Longitude "
    "FROM profile GROUP BY ALL))"
)


def _names_sql(table: str, id_column: str, name: str, source: str) -> str:
    return (
        f"{table} AS (SELECT row_number() OVER (ORDER BY {name}) AS {id_column}, {name} FROM ("
        f"SELECT DISTINCT {source} AS {name} FROM profile WHERE {source} IS NOT NULL AND {source} <> ''))"
    )


DIMS = ",\n".join([
    LOCATIONS,
    _names_sql("PaymentMethods", "PaymentMethodID", "PaymentMethodName", "Payment_Method"),
    _names_sql("ContractTypes", "ContractTypeID", "ContractTypeName", "Contract"),
    _names_sql("ChurnReasons", "ChurnReasonID", "ChurnReason", "Churn_Reason"),
    _names_sql("InternetServices", "InternetServiceID", "InternetServiceType", "Internet_Type"),
    "Clusters AS (SELECT DISTINCT Cluster AS ClusterID, 'Cluster ' || Cluster AS Description FROM profile)",
])


def _decimal(c: str, digits: int) -> str:
    """Half-up rounding of the decimal text of a double, as a decimal column stores it."""
    return f"CAST(round(CAST(CAST({c} AS VARCHAR) AS DECIMAL(38,15)), {digits}) AS DOUBLE)"


def with_dims(select: str) -> str:
    return with_profile(f",\n{DIMS} {select}")


def _lookup_query(name: str):
    def build(spark, sf):
        return N.build_lookup(profile(spark, sf), name)

    return build


for _table in N.LOOKUPS:
    _cols = [c.split()[0] for c in N.LOOKUP_SCHEMAS[_table].split(", ")]
    if _table == "Locations":
        _sql = ("SELECT LocationID, Country, State, City, ZipCode, Population, CAST(Latitude AS DOUBLE) AS Latitude, "
                "CAST(Longitude AS DOUBLE) AS Longitude FROM Locations")

        def _locations(spark, sf):
            return N.build_lookup(profile(spark, sf), "Locations").withColumns({
                c: F.col(c).cast("double") for c in ("Latitude", "Longitude")})

        register("table_locations", "N1 N2 J8 U1", with_dims(_sql))(_locations)
    else:
        register(f"table_{_table.lower()}", "N1 N2 J8 U1", with_dims(f"SELECT {', '.join(_cols)} FROM {_table}"))(
            _lookup_query(_table))


@register("table_clusters", "N8 J9", with_dims("SELECT ClusterID, Description FROM Clusters"))
def _(spark, sf):
    return N.build_clusters(profile(spark, sf))


@register("table_customer_info", "N3 J1 J2", with_dims(
    "SELECT CAST(Customer_ID AS VARCHAR) AS CustomerID, CAST(Gender AS BOOLEAN) AS Gender, Age, "
    "CAST(Senior_Citizen AS BOOLEAN) AS SeniorCitizen, CAST(Under_30 AS BOOLEAN) AS UnderThirty, "
    "CAST(Married AS BOOLEAN) AS Married, CAST(Dependents AS BOOLEAN) AS Dependents, "
    "Number_of_Dependents AS NumberOfDependents, CAST(Referred_a_Friend AS BOOLEAN) AS ReferredAFriend, "
    "Number_of_Referrals AS NumberOfReferrals, LocationID, Customer_Status AS Status, "
    "Satisfaction_Score AS SatisfactionScore, CLTV, ClusterID FROM profile p "
    "LEFT JOIN Locations l ON l.Country = p.Country AND l.State = p.State AND l.City = p.City "
    "AND l.ZipCode = CAST(p.Zip_Code AS VARCHAR) LEFT JOIN Clusters ON ClusterID = p.Cluster"))
def _(spark, sf):
    wide = profile(spark, sf)
    return N.customer_info(wide, N.build_lookup(wide, "Locations"), N.build_clusters(wide))


_SERVICES_SQL = (
    "SELECT CAST(Customer_ID AS VARCHAR) AS CustomerID, InternetServiceID, "
    "CAST(Phone_Service AS BOOLEAN) AS PhoneService, CAST(Multiple_Lines AS BOOLEAN) AS MultipleLines, "
    "CAST(Online_Security AS BOOLEAN) AS OnlineSecurity, CAST(Online_Backup AS BOOLEAN) AS OnlineBackup, "
    "CAST(Device_Protection_Plan AS BOOLEAN) AS DeviceProtection, "
    "CAST(Premium_Tech_Support AS BOOLEAN) AS PremiumTechSupport, CAST(Streaming_TV AS BOOLEAN) AS StreamingTV, "
    "CAST(Streaming_Movies AS BOOLEAN) AS StreamingMovies, CAST(Streaming_Music AS BOOLEAN) AS StreamingMusic, "
    "CAST(Unlimited_Data AS BOOLEAN) AS UnlimitedData FROM profile {} JOIN InternetServices "
    "ON InternetServiceType = Internet_Type")


@register("table_customer_services", "N4 J3", with_dims(_SERVICES_SQL.format("LEFT")))
def _(spark, sf):
    wide = profile(spark, sf)
    return N.customer_services(wide, N.build_lookup(wide, "InternetServices"))


@register("table_customer_services_inner", "N4 J3", with_dims(_SERVICES_SQL.format("INNER")))
def _(spark, sf):
    wide = profile(spark, sf)
    return N.customer_services(wide, N.build_lookup(wide, "InternetServices"), "inner")


@register("table_customer_churn_history", "N5 J4", with_dims(
    "SELECT CAST(Customer_ID AS VARCHAR) AS CustomerID, CAST(Churn_Label AS BOOLEAN) AS ChurnLabel, "
    "Churn_Category AS ChurnCategory, ChurnReasonID, Churn_Score AS ChurnScore FROM profile "
    "LEFT JOIN ChurnReasons ON ChurnReason = Churn_Reason"))
def _(spark, sf):
    wide = profile(spark, sf)
    return N.customer_churn_history(wide, N.build_lookup(wide, "ChurnReasons"))


@register("table_customer_billing", "N6", with_dims(
    "SELECT CAST(Customer_ID AS VARCHAR) AS CustomerID, " + ", ".join(
        f"{_decimal(w, 2)} AS {t}" for t, w in (
            ("MonthlyCharges", "Monthly_Charge"), ("TotalCharges", "Total_Charges"),
            ("TotalExtraDataCharges", "Total_Extra_Data_Charges"),
            ("TotalLongDistanceCharges", "Total_Long_Distance_Charges"), ("TotalRevenue", "Total_Revenue"))
    ) + " FROM profile"))
def _(spark, sf):
    billing = N.customer_billing(profile(spark, sf))
    return billing.select("CustomerID", *[F.col(c).cast("double").alias(c) for c in billing.columns[1:]])


@register("table_customer_contract", "N7 J3", with_dims(
    "SELECT CAST(Customer_ID AS VARCHAR) AS CustomerID, ContractTypeID, Offer AS OfferType, "
    "CAST(Paperless_Billing AS BOOLEAN) AS PaperlessBilling, PaymentMethodID, Tenure_in_Months AS TenureInMonths "
    "FROM profile LEFT JOIN ContractTypes ON ContractTypeName = Contract "
    "LEFT JOIN PaymentMethods ON PaymentMethodName = Payment_Method"))
def _(spark, sf):
    wide = profile(spark, sf)
    return N.customer_contract(wide, N.build_lookup(wide, "ContractTypes"), N.build_lookup(wide, "PaymentMethods"))


@register("clusters_assigned_by_key", "N8 J10 J6", with_profile(
    "SELECT CAST(Customer_ID AS VARCHAR) AS CustomerID, "
    "CASE WHEN Contract = 'F' THEN Satisfaction_Score ELSE Cluster END AS ClusterID FROM profile"))
def _(spark, sf):
    wide = profile(spark, sf)
    info = wide.select(F.col("Customer_ID").cast("string").alias("CustomerID"), F.col("Cluster").alias("ClusterID"))
    moved = wide.filter(F.col("Contract") == "F").select("Customer_ID", F.col("Satisfaction_Score").alias("Cluster"))
    return N.assign_clusters(info, moved)


def _round_trip(c: str) -> str:
    if c in ("Customer_ID", "Zip_Code"):
        return f"CAST({c} AS VARCHAR) AS {c}"
    if c in ("Latitude", "Longitude"):
        return f"CAST({c} AS DOUBLE) AS {c}"
    if c in ("Monthly_Charge", "Total_Charges", "Total_Extra_Data_Charges", "Total_Long_Distance_Charges", "Total_Revenue"):
        return f"{_decimal(c, 2)} AS {c}"
    return c


_LOST = {"Quarter", "Avg_Monthly_Long_Distance_Charges", "Avg_Monthly_GB_Download", "Internet_Service"}
KEPT = [c for c in WIDE_COLUMNS if c not in _LOST]


@register("normalised_round_trip", "N9 J6", with_profile(
    "SELECT " + ", ".join(_round_trip(c) for c in KEPT) + " FROM profile"))
def _(spark, sf):
    wide = profile(spark, sf)
    back = N.denormalize(N.normalize(wide, with_ids=False))
    exact = ["Latitude", "Longitude", "Monthly_Charge", "Total_Charges", "Total_Extra_Data_Charges",
             "Total_Long_Distance_Charges", "Total_Revenue"]
    return back.withColumns({c: F.col(c).cast("double") for c in exact}).select(*KEPT)


@register("constraint_violations", "N10 Q8 J13", with_profile(
    "SELECT 'CustomerInfo' AS \"table\", 'status' AS rule, CAST(Customer_ID AS VARCHAR) AS key FROM profile "
    "WHERE Customer_Status NOT IN ('Churned', 'Stayed', 'Joined') "
    "UNION ALL SELECT 'CustomerInfo', 'reference ClusterID', CAST(Cluster AS VARCHAR) FROM profile WHERE Cluster = 4"))
def _(spark, sf):
    t = N.normalize(profile(spark, sf), with_ids=False)
    t["Clusters"] = t["Clusters"].filter(F.col("ClusterID") != 4)
    return N.constraint_violations(t)


# --- landing files ------------------------------------------------------------------------------------

def _landing_folder(spark, sf) -> str:
    """Raw customer rows written once as CSV files whose headers contain spaces."""
    def write(folder):
        raw = raw_customers(profile(spark, sf))
        spaced = raw.toDF(*[c.replace("_", " ") for c in raw.columns])
        spaced.write.option("header", True).csv(f"{folder}/raw_customers.csv")

    folder = shared_files(spark, "landing", sf, write)
    return f"{folder}/raw_customers.csv"


_RAW_COLUMNS = [c for c in WIDE_COLUMNS if c != "Cluster"]
_TYPED = {
    c for c in _RAW_COLUMNS if c in (
        "Latitude", "Longitude", "Avg_Monthly_Long_Distance_Charges", "Avg_Monthly_GB_Download", "Monthly_Charge",
        "Total_Charges", "Total_Extra_Data_Charges", "Total_Long_Distance_Charges", "Total_Revenue")
}


def _ladder_sql(c: str, position: int) -> str:
    v = f"CAST({c} AS VARCHAR)"
    whole = f"regexp_full_match({v}, '[+-]?[0-9]+')"
    return (
        f"SELECT '{c}' AS \"column\", {position} AS position, CASE WHEN count({c}) = 0 THEN 'string' "
        f"WHEN bool_and({whole} AND TRY_CAST({v} AS SMALLINT) IS NOT NULL) THEN 'smallint' "
        f"WHEN bool_and({whole} AND TRY_CAST({v} AS INT) IS NOT NULL) THEN 'int' "
        f"WHEN bool_and(TRY_CAST({v} AS DOUBLE) IS NOT NULL) THEN 'decimal(18,3)' "
        f"WHEN bool_and(TRY_CAST({v} AS DATE) IS NOT NULL) THEN 'date' ELSE 'string' END AS type, "
        f"count({c}) AS non_null FROM raw_customers WHERE {c} IS NOT NULL"
    )


@register("landing_types", "S5 S6 F1 F2", with_raw(" UNION ALL ".join(
    _ladder_sql(c, i) for i, c in enumerate(_RAW_COLUMNS))))
def _(spark, sf):
    text = L.read_text(spark, _landing_folder(spark, sf))
    return L.infer_types(text).select("column", "position", "type", "non_null")


@register("landing_typed_rows", "S5 S7 S8", with_raw("SELECT " + ", ".join(
    f"{_decimal(c, 3)} AS {c}" if c in _TYPED else c for c in _RAW_COLUMNS
) + " FROM raw_customers"))
def _(spark, sf):
    path = _landing_folder(spark, sf)
    schema = L.schema_from(L.infer_types(L.read_text(spark, path)))
    typed = L.load_typed(spark, path, schema)
    return typed.withColumns({c: F.col(c).cast("double") for c in _TYPED})


def _as_text(c: str) -> str:
    return f"round({c}, 6)" if c in _TYPED else f"CAST({c} AS VARCHAR)"


@register("landing_positional_rows", "S9", with_raw(
    "SELECT " + ", ".join(f"{_as_text(c)} AS col{i}" for i, c in enumerate(_RAW_COLUMNS, 1)) + " FROM raw_customers"))
def _(spark, sf):
    staged = L.read_positional(spark, _landing_folder(spark, sf), len(_RAW_COLUMNS))
    floats = [f"col{i}" for i, c in enumerate(_RAW_COLUMNS, 1) if c in _TYPED]
    return staged.withColumns({c: F.col(c).cast("double") for c in floats})


@register("landing_inferred_rows", "S10", with_raw(
    "SELECT " + ", ".join(f"round({c}, 6) AS {c}" if c in _TYPED else c for c in _RAW_COLUMNS) + " FROM raw_customers"))
def _(spark, sf):
    return L.read_inferred(spark, _landing_folder(spark, sf))


@register("transformed_dataset", "K1 M1 J6", with_profile(
    "SELECT " + ", ".join(f"round({c}, 6) AS {c}" if c in _TYPED else c for c in WIDE_COLUMNS) + " FROM profile"))
def _(spark, sf):
    from tenora.operators.select import encode_binary

    wide = profile(spark, sf).withColumn("_cluster", F.col("Cluster"))  # the raw form has no cluster
    flags = encode_binary(raw_customers(wide), ["Gender", *FLAG_COLUMNS]).withColumnRenamed("_cluster", "Cluster")
    path = scratch_path(spark, "transformed")
    K.write_transformed(flags, path)
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


@register("typed_export", "K2", (
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority "
    "FROM orders"))
def _(spark, sf):
    orders = read_table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    path = scratch_path(spark, "export")
    K.export_typed(orders, path)
    return K.read_export(spark, path)


@register("latest_event_per_user", "K6", (
    "SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts, count(*) AS events FROM events GROUP BY user_id"))
def _(spark, sf):
    return latest_status(read_table(spark, sf, "events"), ["user_id"], "event_type", "ts")


# --- imports that remember -----------------------------------------------------------------------------

_ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
# Sources of the second run: status F unchanged, O changed to its urgent rows, P new, one gone, one that does not fit.
_REGISTRY = {f"orders {s}.csv": "Orders" for s in "FOP"} | {"gone.csv": "Orders", "bad.csv": "Bad"}
_CHANGED = "o_orderstatus <> 'O' OR o_orderpriority = '1-URGENT'"


def _imported_twice(spark, sf) -> ImportLedger:
    """The ledger of two runs over a folder that got a new and a changed source in between; made once per application."""
    def write(root):
        orders = read_table(spark, sf, "orders").select(*_ORDER_COLUMNS)
        cores = spark.sparkContext.defaultParallelism
        if orders.select(F.spark_partition_id().alias("p")).distinct().limit(cores).count() < cores:
            orders = orders.repartition(cores, "o_orderkey")  # a table in few files is written by all cores

        def source(name, rows):
            spaced = rows.toDF(*[c.replace("_", " ") for c in rows.columns])
            spaced.write.mode("overwrite").option("header", True).csv(f"{root}/in/{name}")

        for status in "FO":
            source(f"orders {status}.csv", orders.filter(F.col("o_orderstatus") == status))
        source("bad.csv", orders.select("o_orderpriority"))
        source("orders transformed.csv", orders)  # an output of an earlier run
        source("unmapped.csv", orders.select("o_orderkey"))
        ledger = ImportLedger(spark, f"{root}/out")
        import_new(ledger, f"{root}/in", _REGISTRY, {"Bad": "o_orderpriority int"})
        source("orders O.csv", orders.filter((F.col("o_orderstatus") == "O") & F.expr(_CHANGED)))
        source("orders P.csv", orders.filter("o_orderstatus = 'P'"))
        import_new(ledger, f"{root}/in", _REGISTRY, {"Bad": "o_orderpriority int"})

    return ImportLedger(spark, f"{shared_files(spark, 'imported-twice', sf, write)}/out")


_GOOD, _GONE = "'Success', NULL, NULL, NULL, 10", "'Failed', 'File {} does not exist', NULL, NULL, 16"
_START = "NULL, NULL, NULL, 'Success', 'Found source files', NULL, NULL, 10, NULL"
# The message of the failed load is the reader's own and is left out.
_BAD = "'bad.csv', 'Bad', 'new', 'Data Import Failed', NULL, 'FAILED_READ_FILE.NO_HINT', 'KD001', 16, NULL"
_MISSING = f"'gone.csv', 'Orders', 'missing', {_GONE.format('gone.csv')}, NULL"


@register("import_ledger", "S1 S2 S3 S4 K6 F5 F14", f"""
WITH counts AS (
  SELECT 'F' AS source, count(*) AS n FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'O', count(*) FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT 'changed O', count(*) FROM orders WHERE o_orderstatus = 'O' AND ({_CHANGED})
  UNION ALL SELECT 'P', count(*) FROM orders WHERE o_orderstatus = 'P'),
log(LogID, Run, FileName, TableName, Action, Status, ErrorMessage, ErrorNumber, ErrorState, ErrorSeverity, source) AS (VALUES
  (1, 1, {_START}), (2, 1, {_BAD}), (3, 1, {_MISSING}),
  (4, 1, 'orders F.csv', 'Orders', 'new', {_GOOD}, 'F'),
  (5, 1, 'orders O.csv', 'Orders', 'new', {_GOOD}, 'O'),
  (6, 1, 'orders P.csv', 'Orders', 'missing', {_GONE.format('orders P.csv')}, NULL),
  (7, 2, {_START}), (8, 2, {_BAD}), (9, 2, {_MISSING}),
  (10, 2, 'orders F.csv', 'Orders', 'unchanged', {_GOOD}, NULL),
  (11, 2, 'orders O.csv', 'Orders', 'changed', {_GOOD}, 'changed O'),
  (12, 2, 'orders P.csv', 'Orders', 'new', {_GOOD}, 'P'))
SELECT log.* EXCLUDE (source), n AS "Rows", true AS stamped FROM log LEFT JOIN counts USING (source)""")
def _(spark, sf):
    message = F.when(F.col("Status") != IMPORT_FAILED, F.col("ErrorMessage")).alias("ErrorMessage")
    stamped = F.col("ImportDate").between(F.coalesce("Modified", "ImportDate"), F.current_timestamp()).alias("stamped")
    return _imported_twice(spark, sf).entries().select(
        "LogID", "Run", "FileName", "TableName", "Action", "Status", message, "ErrorNumber", "ErrorState", "ErrorSeverity",
        "Rows", stamped)


@register("imported_table", "S7 S8 S2", (
    f"SELECT o_orderkey, o_custkey, o_orderstatus, {_decimal('o_totalprice', 3)} AS o_totalprice, "
    "CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority, 'orders ' || o_orderstatus || '.csv' AS source_file "
    f"FROM orders WHERE {_CHANGED}"))
def _(spark, sf):
    return _imported_twice(spark, sf).table("Orders").withColumn("o_totalprice", F.col("o_totalprice").cast("double"))
