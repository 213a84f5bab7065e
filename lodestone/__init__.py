"""lodestone: hybrid retrieval and usage analytics over code corpora, on Spark DataFrames."""
