"""Analytics over interaction graphs, and the text and events around them, on Spark DataFrames."""
