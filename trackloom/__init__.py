"""Analytics of time-stamped target reports on Spark: DataFrame operators, sources, streams and saved plans."""
