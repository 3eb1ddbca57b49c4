"""A PySpark-native analytics engine over versioned, linked documents."""
