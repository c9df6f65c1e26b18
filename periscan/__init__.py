"""Period search over many time series at once, written as Spark DataFrame jobs."""
