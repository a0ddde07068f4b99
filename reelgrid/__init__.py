"""Release analytics on Spark."""
