"""Voxstrata: acoustic-feature, longitudinal-statistics and training-data operators on PySpark."""
