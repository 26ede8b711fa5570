"""tablewell: structured agent memory and training-data preparation as Spark DataFrame operations."""
