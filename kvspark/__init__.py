"""kvspark: versioned key-value tables as DataFrames."""
