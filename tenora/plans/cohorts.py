"""Cohort reports over the segmented customer frame. ``focus`` is the cluster looked at in detail."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenora.functions.binning import group_by_edges
from tenora.functions.rates import mean_of, percent_where, share_of
from tenora.functions.text import joined_flags
from tenora.operators.aggregate import (
    churn_among_settled,
    churn_percent,
    correlation_matrix,
    correlation_with,
    group_stats,
    non_null,
    top_k,
    value_counts,
    value_shares,
)
from tenora.operators.bins import Bins, bins_by_status, share_in_range, with_bins
from tenora.operators.quantiles import join_on_keys, medians
from tenora.operators.reshape import crosstab, transpose, unstack, value_share_by_column
from tenora.operators.select import service_columns

# Statuses, charge columns, service labels and tenure groups of the reports.
STATUSES = ["Churned", "Joined", "Stayed"]
CHARGES = [
    "Monthly_Charge", "Total_Charges", "Total_Extra_Data_Charges", "Total_Long_Distance_Charges",
    "Total_Revenue",
]
SERVICE_LABELS = {
    "Online_Security": "OS",
    "Online_Backup": "OB",
    "Device_Protection_Plan": "DP",
    "Premium_Tech_Support": "PTS",
    "Streaming_TV": "STV",
    "Streaming_Movies": "SMV",
    "Streaming_Music": "SMU",
    "Unlimited_Data": "UD",
    "Multiple_Lines": "ML",
    "Phone_Service": "PS",
    "Internet_Service": "IS",
}
TENURE_EDGES = [0, 12, 24, 36, 48, 60, 72]
TENURE_LABELS = ["0-12", "13-24", "25-36", "37-48", "49-60", "61-72"]

CLUSTER, STATUS = "Cluster", "Customer_Status"


def _churned() -> Column:
    return F.col(STATUS) == "Churned"


def in_focus(df: DataFrame, focus: int = 1) -> DataFrame:
    return df.filter(F.col(CLUSTER) == focus)


# --- clusters -----------------------------------------------------------------------------------------

def cluster_stats(df: DataFrame) -> DataFrame:
    return (
        non_null(df, [CLUSTER])
        .groupBy(CLUSTER)
        .agg(
            F.count(F.lit(1)).alias("n"),
            percent_where(_churned()).alias("churn_pct"),
            mean_of("Churn_Score").alias("churn_score_avg"),
            mean_of("CLTV").alias("cltv_avg"),
            mean_of("Tenure_in_Months").alias("tenure_avg"),
        )
        .orderBy(F.desc("churn_pct"), CLUSTER)
    )


def cluster_target_correlation(df: DataFrame) -> DataFrame:
    return correlation_matrix(df, ["CLTV", "Churn_Score", CLUSTER], listwise=True)


def churn_score_threshold(df: DataFrame, size: int = 20, at_least: float = 0.3) -> DataFrame:
    binned = with_bins(df.select("Churn_Score", STATUS), {"bin": Bins("Churn_Score", size)})
    return (
        churn_among_settled(binned, ["bin_ordinal", "bin"], STATUS)
        .filter(F.col("rate") >= at_least)
        .orderBy(F.desc("rate"), "bin_ordinal")
    )


def status_by_cluster(df: DataFrame) -> DataFrame:
    """Status counts per cluster, churn rate among the settled, and each cluster's share of all churned."""
    counts = non_null(df, [CLUSTER]).groupBy(CLUSTER).agg(
        *[F.count_if(F.col(STATUS) == s).alias(s) for s in STATUSES]
    )
    all_churned = F.sum("Churned").over(Window.partitionBy())
    return counts.withColumns({
        "churn_rate_pct": share_of(F.col("Churned"), F.col("Churned") + F.col("Stayed")),
        "share_of_churned_pct": share_of(F.col("Churned"), all_churned),
    })


def churn_score_by_status(df: DataFrame, size: int = 20) -> DataFrame:
    return bins_by_status(df, Bins("Churn_Score", size), STATUS, STATUSES)


def cltv_by_status(df: DataFrame, size: int = 1000) -> DataFrame:
    return bins_by_status(df, Bins("CLTV", size, low=0), STATUS, STATUSES)


def churned_share_in_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return share_in_range(df, column, _churned(), low, high)


def customer_bins(df: DataFrame) -> DataFrame:
    specs = {
        "Age_Bin": Bins("Age", 10),
        "Population_Bin": Bins("Population", 10_000, low=0),
        "Monthly_Charge_Bin": Bins("Monthly_Charge", 10),
        "Tenure_Bin": Bins("Tenure_in_Months", 10),
    }
    added = [c for name in specs for c in (f"{name}_ordinal", name)]
    return with_bins(df, specs).select("Customer_ID", *added)


# --- demographics -------------------------------------------------------------------------------------

def demographics_overview(df: DataFrame) -> DataFrame:
    means = non_null(df, [CLUSTER]).groupBy(CLUSTER).agg(
        mean_of("Gender").alias("gender_ratio"),
        percent_where(F.col("Married") == 1).alias("married_pct"),
        mean_of("Number_of_Dependents").alias("dependents_avg"),
        mean_of("Number_of_Referrals").alias("referrals_avg"),
    )
    both = join_on_keys([means, medians(df, ["Age", "Population"], [CLUSTER])], [CLUSTER])
    return both.withColumns({
        "Age_median": F.col("Age_median").cast("int"),
        "Population_median": F.col("Population_median").cast("int"),
    })


def _city_counts(df: DataFrame) -> DataFrame:
    return value_counts(non_null(df, ["Population"]), "City")


def top_cities(df: DataFrame, focus: int = 1, k: int = 10) -> DataFrame:
    """Largest cities of the focus cluster with their share of its customers."""
    cities = _city_counts(in_focus(df, focus))
    total = cities.select(F.sum("n")).scalar()
    return top_k(cities, "n", k, ["City"]).withColumn("pct", share_of(F.col("n"), total))


def city_profile(df: DataFrame, focus: int = 1, k: int = 10) -> DataFrame:
    """Household profile of the largest cities, with the lowest senior age as the label of that share."""
    senior_from = df.filter(F.col("Senior_Citizen") == 1).select(F.min("Age")).scalar()
    cities = non_null(in_focus(df, focus), ["City", "Population"]).groupBy("City").agg(
        F.count(F.lit(1)).alias("n"),
        (mean_of("Married") * 100).alias("married_pct"),
        mean_of("Number_of_Dependents").alias("household_avg"),
        (mean_of("Under_30") * 100).alias("under_30_pct"),
        (mean_of("Senior_Citizen") * 100).alias("senior_pct"),
    )
    return top_k(cities, "n", k, ["City"]).withColumn("senior_from_age", senior_from)


# --- contracts, offers and services -------------------------------------------------------------------

def contract_distribution(df: DataFrame, values: Sequence | None = None) -> DataFrame:
    return crosstab(df, CLUSTER, "Contract", values)


def offer_distribution(df: DataFrame, values: Sequence | None = None) -> DataFrame:
    return crosstab(df, CLUSTER, "Offer", values)


def _churn_and_means(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return group_stats(
        df, by, {c: ["mean"] for c in columns}, [percent_where(_churned()).alias("churn_pct")]
    )


def contract_impact(df: DataFrame) -> DataFrame:
    return _churn_and_means(df, [CLUSTER, "Contract"], ["Monthly_Charge", "Tenure_in_Months", "Total_Revenue"])


def offer_effectiveness(df: DataFrame) -> DataFrame:
    return _churn_and_means(df, [CLUSTER, "Offer"], ["Monthly_Charge", "Tenure_in_Months", "CLTV"])


def internet_type_by_cluster(df: DataFrame, clusters: Sequence | None = None) -> DataFrame:
    """Each text service: value shares inside every cluster, 0 where a value does not occur."""
    text, _ = service_columns(df)
    shares = value_share_by_column(df, text, CLUSTER)
    return unstack(shares, ["Service", "Value"], CLUSTER, "pct", clusters, fill=0.0, prefix="cluster_")


def services_adoption(df: DataFrame, clusters: Sequence | None = None) -> DataFrame:
    """Adoption percentage of each 0/1 service (rows) in each cluster (columns)."""
    _, flags = service_columns(df)
    means = non_null(df, [CLUSTER]).groupBy(CLUSTER).agg(*[(mean_of(c) * 100).alias(c) for c in flags])
    return transpose(means, CLUSTER, "Service", "cluster_", clusters)


def with_combo(df: DataFrame, labels: Mapping[str, str] = SERVICE_LABELS) -> DataFrame:
    _, flags = service_columns(df)
    return df.withColumn("combo", joined_flags({c: labels[c] for c in flags if c in labels}))


def top_service_combos(df: DataFrame, focus: int = 1, k: int = 5) -> DataFrame:
    return top_k(value_counts(with_combo(in_focus(df, focus)), "combo"), "n", k, ["combo"])


def combo_churn_rate(df: DataFrame, focus: int = 1, k: int = 5) -> DataFrame:
    return top_k(churn_percent(with_combo(in_focus(df, focus)), ["combo"], STATUS), "churn_pct", k, ["combo"])


# --- charges and tenure -------------------------------------------------------------------------------

def charges_overview(df: DataFrame) -> DataFrame:
    return group_stats(df, [CLUSTER], {c: ["mean", "median", "std"] for c in CHARGES})


def with_ratios(df: DataFrame) -> DataFrame:
    """Revenue per month, extra charges and their percentage of revenue; null on a zero denominator."""
    extra = F.col("Total_Extra_Data_Charges") + F.col("Total_Long_Distance_Charges")
    return df.withColumns({
        "Revenue_Per_Month": F.try_divide("Total_Revenue", F.col("Tenure_in_Months").cast("double")),
        "Total_Extra_Charges": extra,
        "Extra_Charges_Pct": F.try_divide(extra, F.col("Total_Revenue")) * 100,
    })


def revenue_efficiency(df: DataFrame) -> DataFrame:
    return group_stats(with_ratios(df), [CLUSTER], {"Revenue_Per_Month": ["mean", "median"]})


def extra_charges_pct(df: DataFrame) -> DataFrame:
    return group_stats(with_ratios(df), [CLUSTER], {"Extra_Charges_Pct": ["mean", "median"]})


def tenure_charge_correlation(df: DataFrame) -> DataFrame:
    return correlation_with(df, "Tenure_in_Months", ["Monthly_Charge", "Total_Charges"], [CLUSTER])


def charges_by(df: DataFrame, by: str, focus: int = 1) -> DataFrame:
    return group_stats(in_focus(df, focus), [by], {c: ["mean"] for c in CHARGES})


def top_revenue(df: DataFrame, focus: int = 1, k: int = 10) -> DataFrame:
    columns = ["Customer_ID", "Total_Revenue", "Monthly_Charge", "Tenure_in_Months", "Contract"]
    return top_k(in_focus(df, focus).select(*columns), "Total_Revenue", k, ["Customer_ID"])


# --- payments -----------------------------------------------------------------------------------------

def payment_distribution(df: DataFrame, values: Sequence | None = None) -> DataFrame:
    return crosstab(df, CLUSTER, "Payment_Method", values)


def churn_by_payment(df: DataFrame, values: Sequence | None = None) -> DataFrame:
    rates = churn_percent(df, [CLUSTER, "Payment_Method"], STATUS)
    return unstack(rates, [CLUSTER], "Payment_Method", "churn_pct", values, prefix="churn_pct_")


def payment_metrics(df: DataFrame, focus: int = 1) -> DataFrame:
    return _churn_and_means(
        with_ratios(in_focus(df, focus)),
        ["Payment_Method"],
        ["Monthly_Charge", "Total_Charges", "Total_Extra_Charges", "Total_Revenue", "Tenure_in_Months"],
    )


def focus_crosstab(
    df: DataFrame, row: str, column: str, focus: int = 1, values: Sequence | None = None
) -> DataFrame:
    return crosstab(in_focus(df, focus), row, column, values)


def churned_by_method(df: DataFrame, focus: int = 1) -> DataFrame:
    return value_shares(in_focus(df, focus).filter(_churned()), "Payment_Method")


# --- satisfaction -------------------------------------------------------------------------------------

def satisfaction_overview(df: DataFrame) -> DataFrame:
    return group_stats(df, [CLUSTER], {"Satisfaction_Score": ["mean", "median", "std", "min", "max"]})


def satisfaction_distribution(df: DataFrame, values: Sequence | None = None) -> DataFrame:
    return crosstab(df, CLUSTER, "Satisfaction_Score", values)


def churn_by_satisfaction(df: DataFrame) -> DataFrame:
    """Churned percentage of all rows with a status, per score; null where nobody churned."""
    rows = non_null(df, ["Satisfaction_Score", STATUS])
    return churn_percent(rows, ["Satisfaction_Score"], STATUS).withColumn(
        "churn_pct", F.when(F.col("churn_pct") > 0, F.col("churn_pct"))
    )


def demographics_by_satisfaction(df: DataFrame, focus: int = 1) -> DataFrame:
    return non_null(in_focus(df, focus), ["Satisfaction_Score"]).groupBy("Satisfaction_Score").agg(
        mean_of("Gender").alias("gender_ratio"),
        mean_of("Age").alias("age_avg"),
        percent_where(F.col("Married") == 1).alias("married_pct"),
        percent_where(F.col("Dependents") == 1).alias("dependents_pct"),
        mean_of("Tenure_in_Months").alias("tenure_avg"),
    )


def services_by_satisfaction(df: DataFrame, focus: int = 1) -> DataFrame:
    _, flags = service_columns(df)
    return non_null(in_focus(df, focus), ["Satisfaction_Score"]).groupBy("Satisfaction_Score").agg(
        *[(mean_of(c) * 100).alias(c) for c in flags]
    )


def charges_by_satisfaction(df: DataFrame, focus: int = 1) -> DataFrame:
    return charges_by(df, "Satisfaction_Score", focus)


def satisfaction_correlation(df: DataFrame) -> DataFrame:
    metrics = ["Churn_Score", "CLTV", "Tenure_in_Months", "Monthly_Charge", "Total_Revenue"]
    return correlation_with(df, "Satisfaction_Score", metrics, [CLUSTER])


def satisfaction_by_tenure_group(df: DataFrame, focus: int = 1) -> DataFrame:
    """Mean satisfaction per tenure group; groups without customers are listed with a null mean."""
    group = group_by_edges(F.col("Tenure_in_Months"), TENURE_EDGES, TENURE_LABELS)["ordinal"]
    means = (
        in_focus(df, focus)
        .groupBy(group.alias("found"))
        .agg(F.count("Satisfaction_Score").alias("n"), mean_of("Satisfaction_Score").alias("satisfaction_avg"))
    )
    groups = df.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(t) for t in TENURE_LABELS])).alias("ordinal", "tenure_group")
    )
    return groups.join(means, F.col("ordinal") == F.col("found"), "left").drop("found").na.fill(0, subset=["n"])
