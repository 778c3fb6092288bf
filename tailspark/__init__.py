"""Tail-risk forecasting and evaluation over panels of daily series, on Spark."""
