"""Function- and data-flow graph analytics on Spark DataFrames."""
