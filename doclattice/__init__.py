"""Documentation consistency analytics on Spark."""
