"""bitloom: Spark-native analytics and clustering of binary fingerprints."""
