"""PySpark-native analytics for literature search."""
