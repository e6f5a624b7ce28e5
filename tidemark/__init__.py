"""PySpark-native vector analytics: logs, snapshots, inverted and clustered indexes."""
