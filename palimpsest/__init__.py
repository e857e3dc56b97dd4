"""Versioned key-value analytics on Spark: point-in-time resolution, sorted runs, compaction, replication logs."""
