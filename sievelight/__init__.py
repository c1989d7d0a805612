"""sievelight: evidence retrieval and run telemetry as lazy Spark plans."""
