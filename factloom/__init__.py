"""factloom: build, check and judge knowledge graphs from text with Spark DataFrames."""
