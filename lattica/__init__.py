"""lattica: graph-corpus analytics (minimum vertex cover by pruning) on Spark DataFrames."""

__version__ = "0.1.0"
