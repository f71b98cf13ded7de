"""Weftline: recording-session analytics on Spark DataFrames."""
