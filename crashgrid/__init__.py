"""Incident analytics on Spark: DataFrame operators for road-accident reports."""
