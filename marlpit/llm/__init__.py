"""Training-data operators: one module for each, all taking and returning DataFrames."""
