"""Star-schema cube analytics on Spark."""
