"""PySpark-native document extraction and faceted search."""
