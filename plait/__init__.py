"""plait: sequence-graph analytics on Spark DataFrames."""
