"""treeline: hierarchies and embeddings of attributed graphs as Spark DataFrames."""
