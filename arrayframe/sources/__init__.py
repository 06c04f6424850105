"""Stores: Parquet datasets by step, time series, campaigns, plugins."""
