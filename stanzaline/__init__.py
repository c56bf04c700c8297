"""Analytics on hierarchically addressed texts, declared as DataFrames."""
