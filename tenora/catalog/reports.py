"""Report queries over the customer profile."""

from __future__ import annotations

from tenora.catalog.profile_sql import with_profile
from tenora.catalog.registry import register
from tenora.plans import cohorts as C
from tenora.plans import exploration as X
from tenora.plans.profile import WIDE_COLUMNS, customer_profile, profile

CONTRACTS, PAYMENTS, SCORES = ["F", "O", "P"], ["A", "N", "R"], [1, 2, 3, 4, 5]
OFFERS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
CLUSTERS = [0, 1, 2, 3, 4]
FLAGS = [
    "Phone_Service", "Internet_Service", "Online_Security", "Online_Backup", "Device_Protection_Plan",
    "Premium_Tech_Support", "Streaming_TV", "Streaming_Movies", "Streaming_Music", "Unlimited_Data",
]
CHURN_PCT = "round(100.0 * count(*) FILTER (WHERE Customer_Status = 'Churned') / count(*), 6) AS churn_pct"


def _quote(v) -> str:
    return f"'{v}'" if isinstance(v, str) else str(v)


def crosstab_sql(row: str, column: str, values: list, where: str = "TRUE") -> str:
    cells = ", ".join(
        f'round(100.0 * count(*) FILTER (WHERE {column} = {_quote(v)}) / count(*), 6) AS "pct_{v}"' for v in values
    )
    return with_profile(
        f"SELECT {row}, {cells} FROM profile WHERE {row} IS NOT NULL AND {column} IS NOT NULL AND {where} GROUP BY {row}"
    )


def means_sql(by: str, columns: list[str], where: str = "TRUE", churn: bool = False, source: str = "profile") -> str:
    keys = [k.strip() for k in by.split(",")]
    cells = ", ".join(f"round(avg({c}), 6) AS {c}_mean" for c in columns)
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return with_profile(
        f"SELECT {by}, {cells}{', ' + CHURN_PCT if churn else ''} FROM {source} WHERE {known} AND {where} GROUP BY {by}"
    )


def corr_sql(a: str, b: str) -> str:
    x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return f"round(covar_pop({a}, {b}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0), 6)"


def corr_matrix_sql(columns: list[str], where: str = "TRUE") -> str:
    return with_profile(" UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, {corr_sql(a, b)} AS r FROM profile WHERE {where}"
        for a in columns for b in columns
    ))


def bin_sql(column: str, size: int, low: str, high: str) -> tuple[str, str]:
    """(ordinal, label) expressions for a right-closed fixed-width bin."""
    ordinal = (
        f"CAST(CASE WHEN {column} = {low} THEN 0 WHEN {column} > {low} AND {column} <= {high} "
        f"THEN ceil(({column} - {low}) / {size}.0) - 1 END AS INT)"
    )
    start = f"({low} + {ordinal} * {size})"
    return ordinal, f"CAST({start} AS VARCHAR) || '-' || CAST({start} + {size} - 1 AS VARCHAR)"


def bounds_sql(column: str, size: int, low: str | None = None) -> str:
    lo = low if low is not None else f"CAST(floor(min({column}) / {size}.0) * {size} AS BIGINT)"
    return f"SELECT CAST({lo} AS BIGINT) AS lo, CAST(ceil(max({column}) / {size}.0) * {size} AS BIGINT) AS hi FROM profile"


@register("customer_profile", "J5 J6 A6 A7 P15", with_profile("SELECT " + ", ".join(
    f"round({c}, 6) AS {c}" if c in (
        "Latitude", "Longitude", "Avg_Monthly_Long_Distance_Charges", "Avg_Monthly_GB_Download", "Monthly_Charge",
        "Total_Charges", "Total_Extra_Data_Charges", "Total_Long_Distance_Charges", "Total_Revenue")
    else c for c in WIDE_COLUMNS) + " FROM profile"))
def _(spark, sf):
    return customer_profile(spark, sf)


# --- exploration --------------------------------------------------------------------------------------

@register("churn_categories", "R1 P4 P5 A11 L1", with_profile(
    "SELECT Churn_Category, count(*) AS n FROM profile WHERE Customer_Status = 'Churned' "
    "AND Churn_Category IS NOT NULL GROUP BY Churn_Category"))
def _(spark, sf):
    return X.churn_categories(profile(spark, sf))


@register("churn_category_top", "R1 A15", with_profile(
    ", c AS (SELECT Churn_Category AS top, count(*) AS top_n FROM profile WHERE Customer_Status = 'Churned' "
    "AND Churn_Category IS NOT NULL GROUP BY 1) "
    "SELECT top, top_n, round(100.0 * top_n / (SELECT sum(top_n) FROM c), 6) AS top_pct FROM c "
    "ORDER BY top_n DESC, top LIMIT 1"))
def _(spark, sf):
    return X.churn_category_top(profile(spark, sf))


@register("churn_reasons", "R2 A11", with_profile(
    "SELECT Churn_Reason, count(*) AS n FROM profile WHERE Customer_Status = 'Churned' "
    "AND Churn_Reason IS NOT NULL GROUP BY Churn_Reason"))
def _(spark, sf):
    return X.churn_reasons(profile(spark, sf))


@register("churn_retention_rate", "R3 A18", with_profile(
    ", c AS (SELECT count(*) FILTER (WHERE Customer_Status = 'Churned') AS churned, "
    "count(*) FILTER (WHERE Customer_Status = 'Stayed') AS stayed, "
    "count(*) FILTER (WHERE Customer_Status = 'Joined') AS joined, count(*) AS n FROM profile) "
    "SELECT churned, stayed, joined, round(100.0 * churned / nullif(n - joined, 0), 6) AS churn_rate, "
    "round(100.0 * stayed / nullif(n - joined, 0), 6) AS retention_rate FROM c"))
def _(spark, sf):
    return X.churn_retention_rate(profile(spark, sf))


@register("charges_correlation", "R4 A16 V3", corr_matrix_sql(X.CHARGES))
def _(spark, sf):
    return X.charges_correlation(profile(spark, sf))


@register("scores_correlation", "R5 A16 V3", corr_matrix_sql(X.SCORES))
def _(spark, sf):
    return X.scores_correlation(profile(spark, sf))


@register("class_balance", "R8 A12 V6", with_profile(
    "SELECT Customer_Status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct "
    "FROM profile GROUP BY Customer_Status"))
def _(spark, sf):
    return X.class_balance(profile(spark, sf))


# --- clusters -----------------------------------------------------------------------------------------

@register("cluster_stats", "R9 A1 A2 A3 L1", with_profile(
    f"SELECT Cluster, count(*) AS n, {CHURN_PCT}, round(avg(Churn_Score), 6) AS churn_score_avg, "
    "round(avg(CLTV), 6) AS cltv_avg, round(avg(Tenure_in_Months), 6) AS tenure_avg FROM profile GROUP BY Cluster"))
def _(spark, sf):
    return C.cluster_stats(profile(spark, sf))


@register("cluster_target_correlation", "R10 P8 A16", corr_matrix_sql(
    ["CLTV", "Churn_Score", "Cluster"], "CLTV IS NOT NULL AND Churn_Score IS NOT NULL AND Cluster IS NOT NULL"))
def _(spark, sf):
    return C.cluster_target_correlation(profile(spark, sf))


_ord20, _lab20 = bin_sql("Churn_Score", 20, "lo", "hi")


@register("churn_score_threshold", "R11 B1 A19 P6", with_profile(
    f", b AS ({bounds_sql('Churn_Score', 20)}), "
    f"c AS (SELECT {_ord20} AS bin_ordinal, {_lab20} AS bin, "
    "count(*) FILTER (WHERE Customer_Status = 'Churned') AS churned, "
    "count(*) FILTER (WHERE Customer_Status = 'Stayed') AS stayed FROM profile, b GROUP BY 1, 2) "
    "SELECT bin_ordinal, bin, churned, stayed, round(churned / nullif(churned + stayed, 0), 6) AS rate FROM c "
    "WHERE bin_ordinal IS NOT NULL AND churned / nullif(churned + stayed, 0) >= 0.3"))
def _(spark, sf):
    return C.churn_score_threshold(profile(spark, sf))


_STATUS_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE Customer_Status = '{s}') AS {s}" for s in C.STATUSES)


@register("status_by_cluster", "R12 A13 X2 A19 A20 V4", with_profile(
    f", c AS (SELECT Cluster, {_STATUS_COUNTS} FROM profile GROUP BY Cluster) "
    "SELECT Cluster, Churned, Joined, Stayed, round(100.0 * Churned / nullif(Churned + Stayed, 0), 6) AS churn_rate_pct, "
    "round(100.0 * Churned / nullif(sum(Churned) OVER (), 0), 6) AS share_of_churned_pct FROM c"))
def _(spark, sf):
    return C.status_by_cluster(profile(spark, sf))


def bins_by_status_sql(column: str, size: int, low: str | None = None) -> str:
    ordinal, _ = bin_sql(column, size, "lo", "hi")
    return with_profile(
        f", b AS ({bounds_sql(column, size, low)}), "
        f"d AS (SELECT unnest(range(lo, hi, {size})) AS start_at, lo FROM b), "
        f"c AS (SELECT {ordinal} AS o, {_STATUS_COUNTS} FROM profile, b GROUP BY 1) "
        f"SELECT CAST((start_at - lo) / {size} AS INT) AS ordinal, "
        f"CAST(start_at AS VARCHAR) || '-' || CAST(start_at + {size} - 1 AS VARCHAR) AS label, "
        "coalesce(Churned, 0) AS Churned, coalesce(Joined, 0) AS Joined, coalesce(Stayed, 0) AS Stayed "
        f"FROM d LEFT JOIN c ON o = (start_at - lo) / {size}")


@register("churn_score_by_status", "R13 B1 B3 X2 P9", bins_by_status_sql("Churn_Score", 20))
def _(spark, sf):
    return C.churn_score_by_status(profile(spark, sf))


@register("cltv_by_status", "R14 B1 B3 X2", bins_by_status_sql("CLTV", 1000, "0"))
def _(spark, sf):
    return C.cltv_by_status(profile(spark, sf))


def range_sql(column: str, low: int, high: int) -> str:
    return with_profile(
        f", c AS (SELECT count(*) FILTER (WHERE {column} > {low} AND {column} <= {high}) AS inside, count(*) AS total "
        "FROM profile WHERE Customer_Status = 'Churned') "
        "SELECT inside, total, round(100.0 * inside / nullif(total, 0), 6) AS share_pct FROM c")


@register("churned_above_score_60", "R13 A20 L5", range_sql("Churn_Score", 60, 100))
def _(spark, sf):
    return C.churned_share_in_range(profile(spark, sf), "Churn_Score", 60, 100)


@register("churned_cltv_2000_6000", "R14 A20 L5", range_sql("CLTV", 2000, 6000))
def _(spark, sf):
    return C.churned_share_in_range(profile(spark, sf), "CLTV", 2000, 6000)


def _customer_bins_sql() -> str:
    ctes, cells, sources = [], [], []
    for i, (column, size, low) in enumerate((
        ("Age", 10, None), ("Population", 10000, "0"), ("Monthly_Charge", 10, None), ("Tenure_in_Months", 10, None)
    )):
        ordinal, label = bin_sql(column, size, f"b{i}.lo", f"b{i}.hi")
        ctes.append(f"b{i} AS ({bounds_sql(column, size, low)})")
        name = {"Tenure_in_Months": "Tenure"}.get(column, column)
        cells.append(f"{ordinal} AS {name}_Bin_ordinal, {label} AS {name}_Bin")
        sources.append(f"b{i}")
    return with_profile(
        f", {', '.join(ctes)} SELECT Customer_ID, {', '.join(cells)} FROM profile, {', '.join(sources)}")


@register("customer_bins", "R49 B1 F6 F12", _customer_bins_sql())
def _(spark, sf):
    return C.customer_bins(profile(spark, sf))


# --- demographics -------------------------------------------------------------------------------------

@register("demographics_overview", "R15 A2 A3 A4 P16", with_profile(
    "SELECT Cluster, round(avg(Gender), 6) AS gender_ratio, "
    "round(100.0 * count(*) FILTER (WHERE Married = 1) / count(*), 6) AS married_pct, "
    "round(avg(Number_of_Dependents), 6) AS dependents_avg, round(avg(Number_of_Referrals), 6) AS referrals_avg, "
    "CAST(trunc(median(Age)) AS INT) AS Age_median, CAST(trunc(median(Population)) AS INT) AS Population_median "
    "FROM profile GROUP BY Cluster"))
def _(spark, sf):
    return C.demographics_overview(profile(spark, sf))


@register("top_cities", "R16 A14 L2 A20 V6", with_profile(
    ", c AS (SELECT City, count(*) AS n FROM profile WHERE Cluster = 1 AND City IS NOT NULL "
    "AND Population IS NOT NULL GROUP BY City) "
    "SELECT City, n, round(100.0 * n / (SELECT sum(n) FROM c), 6) AS pct FROM c ORDER BY n DESC, City LIMIT 10"))
def _(spark, sf):
    return C.top_cities(profile(spark, sf))


@register("city_profile", "R17 J5 L3 A6", with_profile(
    "SELECT City, count(*) AS n, round(avg(Married) * 100, 6) AS married_pct, "
    "round(avg(Number_of_Dependents), 6) AS household_avg, round(avg(Under_30) * 100, 6) AS under_30_pct, "
    "round(avg(Senior_Citizen) * 100, 6) AS senior_pct, "
    "(SELECT min(Age) FROM profile WHERE Senior_Citizen = 1) AS senior_from_age "
    "FROM profile WHERE Cluster = 1 AND City IS NOT NULL AND Population IS NOT NULL "
    "GROUP BY City ORDER BY n DESC, City LIMIT 10"))
def _(spark, sf):
    return C.city_profile(profile(spark, sf))


# --- contracts, offers and services -------------------------------------------------------------------

@register("contract_distribution", "R18 A12 X2 P9 V4", crosstab_sql("Cluster", "Contract", CONTRACTS))
def _(spark, sf):
    return C.contract_distribution(profile(spark, sf), CONTRACTS)


@register("offer_distribution", "R19 A12 X2 V4", crosstab_sql("Cluster", "Offer", OFFERS))
def _(spark, sf):
    return C.offer_distribution(profile(spark, sf), OFFERS)


@register("contract_impact", "R20 A9", means_sql(
    "Cluster, Contract", ["Monthly_Charge", "Tenure_in_Months", "Total_Revenue"], churn=True))
def _(spark, sf):
    return C.contract_impact(profile(spark, sf))


@register("offer_effectiveness", "R21 A9", means_sql(
    "Cluster, Offer", ["Monthly_Charge", "Tenure_in_Months", "CLTV"], churn=True))
def _(spark, sf):
    return C.offer_effectiveness(profile(spark, sf))


_BY_CLUSTER = ", ".join(
    f"coalesce(round(100.0 * count(*) FILTER (WHERE Cluster = {c}) / "
    f"nullif(sum(count(*) FILTER (WHERE Cluster = {c})) OVER (), 0), 6), 0) AS cluster_{c}" for c in CLUSTERS)


@register("internet_type_by_cluster", "R22 P12 X3 X4 X5 V4", with_profile(
    f"SELECT 'Internet_Type' AS Service, Internet_Type AS Value, {_BY_CLUSTER} FROM profile "
    "WHERE Internet_Type IS NOT NULL GROUP BY Internet_Type"))
def _(spark, sf):
    return C.internet_type_by_cluster(profile(spark, sf), CLUSTERS)


@register("services_adoption", "R23 P12 A3 X7 V4", with_profile(" UNION ALL ".join(
    f"SELECT '{f}' AS Service, " + ", ".join(
        f"round(avg({f}) FILTER (WHERE Cluster = {c}) * 100, 6) AS cluster_{c}" for c in CLUSTERS) + " FROM profile"
    for f in FLAGS)))
def _(spark, sf):
    return C.services_adoption(profile(spark, sf), CLUSTERS)


COMBO = "coalesce(array_to_string(list_sort([" + ", ".join(
    f"CASE WHEN {f} = 1 THEN '{C.SERVICE_LABELS[f]}' END" for f in FLAGS
) + "]), ' + '), '')"


@register("top_service_combos", "R24 F10 F11 A11 L3 V6", with_profile(
    f"SELECT {COMBO} AS combo, count(*) AS n FROM profile WHERE Cluster = 1 GROUP BY 1 ORDER BY n DESC, combo LIMIT 5"))
def _(spark, sf):
    return C.top_service_combos(profile(spark, sf))


@register("combo_churn_rate", "R25 F10 A2 L3", with_profile(
    f"SELECT {COMBO} AS combo, {CHURN_PCT} FROM profile WHERE Cluster = 1 GROUP BY 1 "
    "ORDER BY churn_pct DESC, combo LIMIT 5"))
def _(spark, sf):
    return C.combo_churn_rate(profile(spark, sf))


# --- charges and tenure -------------------------------------------------------------------------------

def stats_sql(columns: list[str], stats: list[str], source: str = "profile") -> str:
    fn = {"mean": "avg({})", "median": "median({})", "std": "stddev_samp({})"}
    cells = ", ".join(f"round({fn[s].format(c)}, 6) AS {c}_{s}" for c in columns for s in stats)
    return with_profile(f"SELECT Cluster, {cells} FROM {source} GROUP BY Cluster")


RATIOS = (
    "(SELECT *, Total_Revenue / nullif(Tenure_in_Months, 0) AS Revenue_Per_Month, "
    "Total_Extra_Data_Charges + Total_Long_Distance_Charges AS Total_Extra_Charges, "
    "(Total_Extra_Data_Charges + Total_Long_Distance_Charges) / nullif(Total_Revenue, 0) * 100 AS Extra_Charges_Pct "
    "FROM profile)"
)


@register("charges_overview", "R26 A4 A5 A8", stats_sql(C.CHARGES, ["mean", "median", "std"]))
def _(spark, sf):
    return C.charges_overview(profile(spark, sf))


@register("revenue_efficiency", "R27 P15 A8 F13", stats_sql(["Revenue_Per_Month"], ["mean", "median"], RATIOS))
def _(spark, sf):
    return C.revenue_efficiency(profile(spark, sf))


@register("extra_charges_pct", "R28 P15 A8 F13", stats_sql(["Extra_Charges_Pct"], ["mean", "median"], RATIOS))
def _(spark, sf):
    return C.extra_charges_pct(profile(spark, sf))


@register("tenure_charge_correlation", "R29 A17", with_profile(
    f"SELECT Cluster, {corr_sql('Tenure_in_Months', 'Monthly_Charge')} AS corr_Monthly_Charge, "
    f"{corr_sql('Tenure_in_Months', 'Total_Charges')} AS corr_Total_Charges FROM profile GROUP BY Cluster"))
def _(spark, sf):
    return C.tenure_charge_correlation(profile(spark, sf))


@register("charges_by_contract_focus", "R30 A3", means_sql("Contract", C.CHARGES, "Cluster = 1"))
def _(spark, sf):
    return C.charges_by(profile(spark, sf), "Contract")


@register("charges_by_internet_focus", "R31 A3", means_sql("Internet_Type", C.CHARGES, "Cluster = 1"))
def _(spark, sf):
    return C.charges_by(profile(spark, sf), "Internet_Type")


@register("top_revenue_focus", "R32 L2 P1", with_profile(
    "SELECT Customer_ID, round(Total_Revenue, 6) AS Total_Revenue, round(Monthly_Charge, 6) AS Monthly_Charge, "
    "Tenure_in_Months, Contract FROM profile WHERE Cluster = 1 "
    "ORDER BY profile.Total_Revenue DESC, Customer_ID LIMIT 10"))
def _(spark, sf):
    return C.top_revenue(profile(spark, sf))


# --- payments -----------------------------------------------------------------------------------------

@register("payment_distribution", "R33 X1 V4", crosstab_sql("Cluster", "Payment_Method", PAYMENTS))
def _(spark, sf):
    return C.payment_distribution(profile(spark, sf), PAYMENTS)


@register("churn_by_payment", "R34 A2 X2", with_profile("SELECT Cluster, " + ", ".join(
    f"round(100.0 * count(*) FILTER (WHERE Payment_Method = '{p}' AND Customer_Status = 'Churned') / "
    f"nullif(count(*) FILTER (WHERE Payment_Method = '{p}'), 0), 6) AS churn_pct_{p}" for p in PAYMENTS
) + " FROM profile WHERE Payment_Method IS NOT NULL GROUP BY Cluster"))
def _(spark, sf):
    return C.churn_by_payment(profile(spark, sf), PAYMENTS)


@register("payment_metrics_focus", "R35 P15 A9 X8", means_sql(
    "Payment_Method",
    ["Monthly_Charge", "Total_Charges", "Total_Extra_Charges", "Total_Revenue", "Tenure_in_Months"],
    "Cluster = 1", True, RATIOS))
def _(spark, sf):
    return C.payment_metrics(profile(spark, sf))


@register("payment_by_contract_focus", "R36 X1", crosstab_sql("Contract", "Payment_Method", PAYMENTS, "Cluster = 1"))
def _(spark, sf):
    return C.focus_crosstab(profile(spark, sf), "Contract", "Payment_Method", values=PAYMENTS)


@register("payment_by_internet_focus", "R37 X1", crosstab_sql(
    "Internet_Type", "Payment_Method", PAYMENTS, "Cluster = 1"))
def _(spark, sf):
    return C.focus_crosstab(profile(spark, sf), "Internet_Type", "Payment_Method", values=PAYMENTS)


@register("churned_by_method_focus", "R38 P4 A11 A12", with_profile(
    "SELECT Payment_Method, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM profile "
    "WHERE Cluster = 1 AND Customer_Status = 'Churned' AND Payment_Method IS NOT NULL GROUP BY Payment_Method"))
def _(spark, sf):
    return C.churned_by_method(profile(spark, sf))


# --- satisfaction -------------------------------------------------------------------------------------

@register("satisfaction_overview", "R39 A8 A5 A6", with_profile(
    "SELECT Cluster, round(avg(Satisfaction_Score), 6) AS Satisfaction_Score_mean, "
    "round(median(Satisfaction_Score), 6) AS Satisfaction_Score_median, "
    "round(stddev_samp(Satisfaction_Score), 6) AS Satisfaction_Score_std, "
    "min(Satisfaction_Score) AS Satisfaction_Score_min, max(Satisfaction_Score) AS Satisfaction_Score_max "
    "FROM profile GROUP BY Cluster"))
def _(spark, sf):
    return C.satisfaction_overview(profile(spark, sf))


@register("satisfaction_distribution", "R40 X1 V4", crosstab_sql("Cluster", "Satisfaction_Score", SCORES))
def _(spark, sf):
    return C.satisfaction_distribution(profile(spark, sf), SCORES)


@register("churn_by_satisfaction", "R41 A13 X6 V6", with_profile(
    "SELECT Satisfaction_Score, round(nullif(100.0 * count(*) FILTER (WHERE Customer_Status = 'Churned') / count(*), 0), 6) "
    "AS churn_pct FROM profile WHERE Satisfaction_Score IS NOT NULL GROUP BY Satisfaction_Score"))
def _(spark, sf):
    return C.churn_by_satisfaction(profile(spark, sf))


@register("demographics_by_satisfaction_focus", "R42 A2 A3", with_profile(
    "SELECT Satisfaction_Score, round(avg(Gender), 6) AS gender_ratio, round(avg(Age), 6) AS age_avg, "
    "round(100.0 * count(*) FILTER (WHERE Married = 1) / count(*), 6) AS married_pct, "
    "round(100.0 * count(*) FILTER (WHERE Dependents = 1) / count(*), 6) AS dependents_pct, "
    "round(avg(Tenure_in_Months), 6) AS tenure_avg FROM profile WHERE Cluster = 1 GROUP BY Satisfaction_Score"))
def _(spark, sf):
    return C.demographics_by_satisfaction(profile(spark, sf))


@register("services_by_satisfaction_focus", "R43 P12 A3", with_profile(
    "SELECT Satisfaction_Score, " + ", ".join(f"round(avg({f}) * 100, 6) AS {f}" for f in FLAGS) +
    " FROM profile WHERE Cluster = 1 GROUP BY Satisfaction_Score"))
def _(spark, sf):
    return C.services_by_satisfaction(profile(spark, sf))


@register("satisfaction_by_contract_focus", "R44 X1 V3", crosstab_sql(
    "Contract", "Satisfaction_Score", SCORES, "Cluster = 1"))
def _(spark, sf):
    return C.focus_crosstab(profile(spark, sf), "Contract", "Satisfaction_Score", values=SCORES)


@register("satisfaction_by_payment_focus", "R45 X1", crosstab_sql(
    "Payment_Method", "Satisfaction_Score", SCORES, "Cluster = 1"))
def _(spark, sf):
    return C.focus_crosstab(profile(spark, sf), "Payment_Method", "Satisfaction_Score", values=SCORES)


@register("charges_by_satisfaction_focus", "R46 A3", means_sql("Satisfaction_Score", C.CHARGES, "Cluster = 1"))
def _(spark, sf):
    return C.charges_by_satisfaction(profile(spark, sf))


@register("satisfaction_correlation", "R47 A17", with_profile("SELECT Cluster, " + ", ".join(
    f"{corr_sql('Satisfaction_Score', c)} AS corr_{c}"
    for c in ("Churn_Score", "CLTV", "Tenure_in_Months", "Monthly_Charge", "Total_Revenue")
) + " FROM profile GROUP BY Cluster"))
def _(spark, sf):
    return C.satisfaction_correlation(profile(spark, sf))


_TENURE = "CASE " + " ".join(
    f"WHEN Tenure_in_Months > {a} AND Tenure_in_Months <= {b} THEN {i}"
    for i, (a, b) in enumerate(zip(C.TENURE_EDGES, C.TENURE_EDGES[1:]))) + " END"
_GROUPS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(C.TENURE_LABELS))


@register("satisfaction_by_tenure_group_focus", "R48 B2 A3 V6", with_profile(
    f", g(ordinal, tenure_group) AS (VALUES {_GROUPS}), "
    f"c AS (SELECT {_TENURE} AS o, count(Satisfaction_Score) AS n, avg(Satisfaction_Score) AS m FROM profile "
    "WHERE Cluster = 1 GROUP BY 1) "
    "SELECT ordinal, tenure_group, coalesce(n, 0) AS n, round(m, 6) AS satisfaction_avg FROM g LEFT JOIN c ON o = ordinal"))
def _(spark, sf):
    return C.satisfaction_by_tenure_group(profile(spark, sf))
