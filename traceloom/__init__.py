"""Analytics over sampled reasoning traces, declared as Spark DataFrames."""
