"""A PySpark-native engine that validates model output against observations and analyses collections of time series."""
