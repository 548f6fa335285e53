"""Conditional graph analytics and the data preparation around it, on Spark DataFrames."""
