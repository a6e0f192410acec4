"""Session analytics on Spark."""
