"""tracework: Spark-native analytics over evidence-anchored documents and event sequences."""
