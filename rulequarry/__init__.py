"""Behavioural-rule mining and checking over event traces, expressed as Spark DataFrames."""
