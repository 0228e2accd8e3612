"""Recording analytics as Spark DataFrame plans."""
