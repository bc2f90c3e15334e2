"""gridloom: spatial analysis of gridded data with irregular coverage, on Spark DataFrames."""
