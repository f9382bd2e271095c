"""Vehicle arrival-delay analytics as Spark jobs."""
