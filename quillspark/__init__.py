"""A Spark-native engine for running and curating a multilingual text library."""
