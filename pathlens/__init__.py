"""File-metadata search and change tracking on Spark DataFrames."""
