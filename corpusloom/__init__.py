"""corpusloom: speech- and text-corpus preparation as Spark DataFrames."""
