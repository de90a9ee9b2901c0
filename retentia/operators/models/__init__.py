"""Churn, lifetime-value, segmentation and next-service models on Spark ML."""
