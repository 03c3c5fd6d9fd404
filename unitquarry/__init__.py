"""Spark-native retrieval and structure engine for versioned libraries of Object Pascal source."""
