"""Cohort and churn analytics on Spark: ingest, profile, segment, report and normalise customer tables."""

__version__ = "0.1.0"
