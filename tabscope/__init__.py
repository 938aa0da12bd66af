"""Profiling, cleansing and chart data for tables on Spark."""
