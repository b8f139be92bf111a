"""A PySpark-native engine that evaluates rules over text and source-code corpora."""
