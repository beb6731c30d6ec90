"""Platform event and metadata analytics as Spark DataFrame jobs."""
