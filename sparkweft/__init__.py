"""sparkweft: property-graph analytics on Spark DataFrames."""
