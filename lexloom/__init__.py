"""lexloom: Spark-native corpus analytics."""
