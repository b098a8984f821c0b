"""tidemark: a PySpark-native research engine for daily (date, ticker) panels."""
