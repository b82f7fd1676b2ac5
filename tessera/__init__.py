"""tessera: document analytics on Spark DataFrames."""
