"""Web-research analytics as Spark DataFrame operators."""
