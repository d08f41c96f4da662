"""The customer profile as portable SQL; every report check starts from this text."""

from tenora.plans.profile import FLAG_COLUMNS, SERVICE_BY_PART_TYPE, WIDE_COLUMNS

_SERVICES = ",\n      ".join(
    f"max(CASE WHEN p_type = '{kind}' THEN 1 ELSE 0 END) AS {service}"
    for service, kind in SERVICE_BY_PART_TYPE.items()
)
_SERVICE_FLAGS = ",\n      ".join(f"coalesce(ll.{s}, 0) AS {s}" for s in SERVICE_BY_PART_TYPE)

PROFILE = f"""
last_orders AS (
  SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE) AS last_day
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
        FROM orders) WHERE rn = 1),
order_totals AS (
  SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first_day,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS revenue
  FROM orders GROUP BY o_custkey),
line_totals AS (
  SELECT o_custkey,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS charges,
         CAST(sum(CAST(l_extendedprice * l_tax AS DECIMAL(18,4))) AS DOUBLE) AS extra_data,
         CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18,4))) AS DOUBLE) AS long_distance,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey),
last_lines AS (
  SELECT o_custkey, max(l_returnflag) AS max_flag, min(p_type) AS min_type, count(*) AS n_lines,
         max(l_quantity) AS max_quantity,
      {_SERVICES}
  FROM last_orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  GROUP BY o_custkey),
day_bounds AS (SELECT min(CAST(o_orderdate AS DATE)) AS mn, max(CAST(o_orderdate AS DATE)) AS mx FROM orders),
segments AS (
  SELECT c_mktsegment AS segment, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS cluster_no
  FROM (SELECT DISTINCT c_mktsegment FROM customer)),
profile_base AS (
  SELECT c_custkey AS Customer_ID,
      CAST(c_custkey % 2 AS INT) AS Gender,
      CAST(18 + c_custkey % 63 AS INT) AS Age,
      CAST(c_custkey % 5 < 2 AS INT) AS Married,
      CAST(c_custkey % 7 % 4 AS INT) AS Number_of_Dependents,
      CAST(c_custkey * 7 % 12 AS INT) AS Number_of_Referrals,
      'World' AS Country, r_name AS State, n_name AS City,
      CAST(10000 + c_nationkey * 100 + c_custkey % 10 AS INT) AS Zip_Code,
      CAST(c_nationkey * 1.5 - 20 AS DOUBLE) AS Latitude,
      CAST(c_nationkey * 3.25 - 40 AS DOUBLE) AS Longitude,
      CAST((c_nationkey + 1) * 1000 + c_custkey % 10 * 700 AS INT) AS Population,
      'Q3' AS Quarter,
      CAST(coalesce((year(last_day) * 12 + month(last_day)) - (year(first_day) * 12 + month(first_day)), 0) AS INT)
        AS Tenure_in_Months,
      o_orderpriority AS Offer, o_orderstatus AS Contract, max_flag AS Payment_Method, min_type AS Internet_Type,
      coalesce(CAST(max_quantity >= 25 AS INT), 0) AS Phone_Service,
      coalesce(CAST(n_lines > 1 AS INT), 0) AS Multiple_Lines,
      coalesce(CAST(n_lines > 0 AS INT), 0) AS Internet_Service,
      coalesce(CAST(max_flag = 'R' AS INT), 0) AS Streaming_Music,
      coalesce(CAST(max_quantity >= 45 AS INT), 0) AS Unlimited_Data,
      {_SERVICE_FLAGS},
      CAST(c_custkey % 3 <> 0 AS INT) AS Paperless_Billing,
      coalesce(revenue, 0.0) AS Total_Revenue, coalesce(charges, 0.0) AS Total_Charges,
      coalesce(extra_data, 0.0) AS Total_Extra_Data_Charges,
      coalesce(long_distance, 0.0) AS Total_Long_Distance_Charges,
      coalesce(quantity, 0.0) AS quantity,
      CAST(least(5, floor((c_acctbal + 1000) / 2200) + 1) AS INT) AS Satisfaction_Score,
      CAST(floor(c_acctbal + 1000) AS INT) AS CLTV,
      CASE WHEN last_day IS NULL THEN 'Joined'
           WHEN last_day < mx - 180 THEN 'Churned'
           WHEN first_day >= mn + 365 THEN 'Joined'
           ELSE 'Stayed' END AS Customer_Status,
      CAST(coalesce(least(100, floor((mx - last_day) / 10)), 0) AS INT) AS Churn_Score,
      cluster_no AS Cluster
  FROM customer c
  LEFT JOIN last_orders lo ON lo.o_custkey = c_custkey
  LEFT JOIN order_totals ot ON ot.o_custkey = c_custkey
  LEFT JOIN line_totals lt ON lt.o_custkey = c_custkey
  LEFT JOIN last_lines ll ON ll.o_custkey = c_custkey
  LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN segments ON segment = c_mktsegment
  CROSS JOIN day_bounds),
profile_full AS (
  SELECT *, CAST(Age < 30 AS INT) AS Under_30, CAST(Age >= 65 AS INT) AS Senior_Citizen,
      CAST(Number_of_Dependents > 0 AS INT) AS Dependents,
      CAST(Number_of_Referrals > 0 AS INT) AS Referred_a_Friend,
      Total_Revenue / greatest(Tenure_in_Months, 1) AS Monthly_Charge,
      Total_Long_Distance_Charges / greatest(Tenure_in_Months, 1) AS Avg_Monthly_Long_Distance_Charges,
      quantity / greatest(Tenure_in_Months, 1) AS Avg_Monthly_GB_Download,
      CAST(Customer_Status = 'Churned' AS INT) AS Churn_Label,
      CASE WHEN Customer_Status = 'Churned' THEN Offer END AS Churn_Category,
      CASE WHEN Customer_Status = 'Churned' THEN Internet_Type END AS Churn_Reason
  FROM profile_base),
profile AS (SELECT {", ".join(WIDE_COLUMNS)} FROM profile_full)"""

RAW = "raw_customers AS (SELECT " + ", ".join(
    "CASE WHEN Gender = 1 THEN 'Male' ELSE 'Female' END AS Gender" if c == "Gender"
    else f"CASE WHEN {c} = 1 THEN 'Yes' ELSE 'No' END AS {c}" if c in FLAG_COLUMNS
    else c
    for c in WIDE_COLUMNS if c != "Cluster"
) + " FROM profile)"


def with_profile(body: str) -> str:
    """``body`` (a SELECT, or further CTEs and a SELECT introduced by a leading comma) over ``profile``."""
    return f"WITH {PROFILE}{'' if body.lstrip().startswith(',') else ' '}{body}"


def with_raw(body: str) -> str:
    """The same with ``raw_customers`` available as well."""
    return f"WITH {PROFILE},\n{RAW}{'' if body.lstrip().startswith(',') else ' '}{body}"
