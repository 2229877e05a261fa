"""Schema-change impact analytics as Spark jobs."""
