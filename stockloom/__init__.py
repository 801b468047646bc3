"""Retail inventory analytics as PySpark DataFrame operators."""
