"""Gridded and time-series wetland analytics as Spark DataFrame operators."""
