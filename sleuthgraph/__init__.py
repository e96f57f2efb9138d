"""Security-incident analytics over Spark DataFrames."""
