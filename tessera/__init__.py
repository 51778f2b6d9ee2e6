"""A Spark-first code index and retrieval engine: every operator is a DataFrame -> DataFrame function."""
