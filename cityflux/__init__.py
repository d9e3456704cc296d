"""City-sensor analytics on Spark: readings of air quality and road traffic, from raw payload to report."""
