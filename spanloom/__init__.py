"""spanloom: temporal-interval analytics on Spark DataFrames."""
