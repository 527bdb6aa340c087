"""trovespark: hybrid-retrieval analytics expressed with Spark DataFrames."""
