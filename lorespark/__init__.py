"""lorespark: a PySpark-native analytics engine for knowledge bases and training corpora."""
