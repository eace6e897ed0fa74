"""Page-view and page-edit analytics on Spark DataFrames and Structured Streaming."""
