"""Sources: tables in, DataFrames out."""
