"""Payload profiling, dataset audits and leakage-safe evaluation on Spark DataFrames."""
