"""Document-to-requirement analytics on PySpark: scan, extract, score, rank, explain."""
