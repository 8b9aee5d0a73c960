"""Robust aggregation and corpus preparation as Spark jobs."""
