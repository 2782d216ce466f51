"""A Spark-native engine for curating media-style libraries and text corpora."""
