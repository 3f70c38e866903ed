"""evalloom: paired-experiment analytics on Spark DataFrames."""
