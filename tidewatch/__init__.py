"""Security-event analytics on Spark: operators from DataFrame to DataFrame, batch and streaming."""
