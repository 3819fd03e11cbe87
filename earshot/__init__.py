"""Detection data and evaluation on Spark."""
