"""Payment reliability analytics as Spark DataFrame operators."""
