"""tracewell: Spark-native analytics for payment ledgers."""
