"""CDN access-log analytics as PySpark DataFrame jobs."""
