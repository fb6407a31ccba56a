"""quire: document-translation analytics on Spark DataFrames."""
