"""wardline: security event correlation and corpus preparation on Spark."""
