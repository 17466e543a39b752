"""Temporal graph analytics on Spark."""
