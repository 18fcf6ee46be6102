"""moraine: snapshot, chunk and archive analytics on Spark DataFrames."""
