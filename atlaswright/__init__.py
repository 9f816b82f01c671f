"""Map-knowledge analytics on Spark: DataFrame operators over many annotated maps at once."""
