"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; it stands on pyspark, pyarrow, numpy and the small
libraries named in each module.
"""
