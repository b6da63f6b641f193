"""Point-in-time panel analytics as Spark DataFrame and SQL plans."""
