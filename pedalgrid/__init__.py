"""Active-mobility analytics as Spark DataFrame operators."""
