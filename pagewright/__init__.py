"""Document search, page classification and corpus preparation on Spark."""
