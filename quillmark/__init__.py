"""A PySpark-native engine for hybrid text search, structural analytics and corpus preparation."""
