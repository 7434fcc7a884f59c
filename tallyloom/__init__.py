"""Document mapping and reconciliation on Spark DataFrames."""
