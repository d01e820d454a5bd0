"""Set-oriented jobs: DataFrames in, DataFrames out."""
