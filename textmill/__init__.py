"""A PySpark-native engine for text corpora and tool-execution logs."""
