"""A Spark-native engine for learning analytics, retrieval and curriculum text."""
