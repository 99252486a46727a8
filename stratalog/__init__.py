"""Multi-version keyed data and corpus processing on Spark."""
