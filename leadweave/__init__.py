"""Lead finding, routing, scoring and measurement as Spark jobs."""
