"""Interval, sequence and time-to-event analytics on Spark DataFrames."""
