"""Exploratory reports over the whole customer frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenora.operators.aggregate import (
    churn_and_retention,
    correlation_matrix,
    mode_with_share,
    value_counts,
    value_shares,
)
from tenora.operators.plotdata import box_stats, histograms
from tenora.operators.select import columns_of

CHARGES = [
    "Avg_Monthly_Long_Distance_Charges", "Monthly_Charge", "Total_Charges", "Total_Extra_Data_Charges",
    "Total_Long_Distance_Charges", "Total_Revenue",
]
SCORES = ["Satisfaction_Score", "Churn_Score", "CLTV"]


def churned_only(df: DataFrame, status: str = "Customer_Status", churned: str = "Churned") -> DataFrame:
    return df.filter(F.col(status) == churned)


def churn_categories(df: DataFrame) -> DataFrame:
    return value_counts(churned_only(df), "Churn_Category").orderBy(F.desc("n"), "Churn_Category")


def churn_category_top(df: DataFrame) -> DataFrame:
    return mode_with_share(churned_only(df), "Churn_Category")


def churn_reasons(df: DataFrame) -> DataFrame:
    return value_counts(churned_only(df), "Churn_Reason").orderBy(F.desc("n"), "Churn_Reason")


def churn_retention_rate(df: DataFrame) -> DataFrame:
    return churn_and_retention(df, "Customer_Status")


def charges_correlation(df: DataFrame, columns: Sequence[str] = CHARGES) -> DataFrame:
    return correlation_matrix(df, columns)


def scores_correlation(df: DataFrame, columns: Sequence[str] = SCORES) -> DataFrame:
    return correlation_matrix(df, columns)


def report_numeric_columns(df: DataFrame, leave_out: Sequence[str] = ("Customer_ID", "Zip_Code")) -> list[str]:
    return [c for c in columns_of(df, "numeric") if c not in leave_out]


def numeric_distributions(df: DataFrame, bins: int = 10) -> DataFrame:
    return histograms(df, report_numeric_columns(df), bins)


def numeric_outliers(df: DataFrame) -> DataFrame:
    return box_stats(df, report_numeric_columns(df))


def class_balance(df: DataFrame) -> DataFrame:
    return value_shares(df, "Customer_Status")
