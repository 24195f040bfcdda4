"""A Spark-first engine for document-grounded prediction analytics."""
