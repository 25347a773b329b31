"""Credit scorecard analytics as Spark DataFrame operators."""
