"""Trial-log analytics as Spark DataFrame plans."""
