"""Repository analytics as Spark DataFrame jobs."""
