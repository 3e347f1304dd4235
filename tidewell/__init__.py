"""Analytics over versioned keyed records, on Spark DataFrames."""
