"""A PySpark-native engine for ordered time-series, retrieval and standings analytics."""
