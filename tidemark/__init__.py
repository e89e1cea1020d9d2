"""PySpark-native analytics for bitemporal time-series panels."""
