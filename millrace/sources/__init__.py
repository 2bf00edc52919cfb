"""Reading sources into DataFrames and writing results."""
