"""Query operators over DataFrames."""
