"""ringweave: Spark-native ring detection over a payment network."""
