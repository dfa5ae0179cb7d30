"""loomtext: a Spark-native text search and analytics engine."""
