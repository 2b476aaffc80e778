"""Part of tamarix, a PySpark-native analytics engine."""
