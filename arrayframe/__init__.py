"""PySpark-native engine for step-versioned n-dimensional arrays."""
