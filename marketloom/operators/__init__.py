"""Operators on long panels (date, ticker, measures): functions from DataFrames to DataFrames."""
