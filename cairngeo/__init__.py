"""Geodata deliveries, layers, feeds and point tables as PySpark DataFrames."""

__version__ = "0.1.0"
