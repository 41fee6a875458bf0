"""Table jobs: DataFrames in, DataFrames out."""
