"""Data-quality, schema-harmonisation and entity-to-asset matching over Spark DataFrames."""
