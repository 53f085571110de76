"""tilewright: Spark-native analytics for archives of satellite-image tiles."""
