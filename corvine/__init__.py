"""Code-graph, retrieval and data-preparation analytics on Spark DataFrames."""
