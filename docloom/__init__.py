"""Documentation-pair corpora of source code, built and evaluated with Spark DataFrames."""
