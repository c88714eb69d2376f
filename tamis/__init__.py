"""tamis: a PySpark-native engine for building, checking and scoring text-to-SQL corpora."""
