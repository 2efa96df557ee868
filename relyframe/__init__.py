"""Transfer-reliability analytics as Spark DataFrame operators."""
