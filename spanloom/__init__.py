"""A PySpark-native engine for span analytics over large text corpora."""
