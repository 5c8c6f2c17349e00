"""logweave: a PySpark-native engine for versioned key-value command logs."""
