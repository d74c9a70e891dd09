"""A Spark-first analytics engine for point-in-time research data."""
