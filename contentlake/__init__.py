"""contentlake: a PySpark-native engine for archives of syndicated content."""
