"""Analytics for laser-scanning microscopy recordings on PySpark DataFrames."""
