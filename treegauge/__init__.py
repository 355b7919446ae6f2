"""treegauge: repository health analytics as Spark DataFrame plans."""
