"""Subscription and churn analytics as Spark DataFrame operators."""
