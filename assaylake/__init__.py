"""Evidence analytics as Spark DataFrame, SQL and Structured Streaming plans."""
