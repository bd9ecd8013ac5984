"""Lead discovery and corpus preparation as Spark jobs."""
