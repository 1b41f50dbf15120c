"""A PySpark-native analytics, data-mining and record-linkage engine."""
