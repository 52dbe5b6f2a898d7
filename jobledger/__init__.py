"""Archive, search and aggregate batch-job reports with Spark DataFrames."""
