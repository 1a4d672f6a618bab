"""Document retrieval and learning analytics as Spark DataFrame operators."""
