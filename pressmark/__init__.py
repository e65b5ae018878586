"""pressmark: text-classification analytics as Spark DataFrame jobs."""
