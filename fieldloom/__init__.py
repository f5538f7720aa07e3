"""A PySpark-native engine that turns documents into curated, queryable records."""
