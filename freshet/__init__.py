"""Hydrology and weather analytics as Spark DataFrame operators."""
