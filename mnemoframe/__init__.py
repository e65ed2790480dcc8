"""A Spark-native analytics engine for conversational and document text."""
