"""Content-intelligence analytics on Spark: DataFrame operators, sources, streaming and evaluation."""
