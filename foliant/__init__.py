"""Document-structure and quality analytics as Spark DataFrame operators."""
