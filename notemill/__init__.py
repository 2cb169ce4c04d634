"""A PySpark-native engine that turns captured web content into numbered notes."""
