"""tessera: a PySpark-native engine for knowledge, conversation and corpus data."""
