"""A PySpark-native engine for feed ingestion, article text and the tables around them."""
