"""Longitudinal event analytics and training-data preparation on PySpark."""
