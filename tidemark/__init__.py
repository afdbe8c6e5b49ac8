"""Market-data analytics on tables and streams, written as Spark jobs."""
