"""Document-structure engine on Spark DataFrames."""
