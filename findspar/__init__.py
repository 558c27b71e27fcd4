"""Document search, answer verification and corpus preparation as PySpark plans."""
