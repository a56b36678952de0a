"""yardspark: yard analytics on Spark DataFrames and Structured Streaming."""
