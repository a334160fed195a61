"""rushes: Spark-native analytics for libraries of RAW camera footage."""
