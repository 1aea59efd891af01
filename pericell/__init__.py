"""Periodic point-set analytics on PySpark: frames, atoms and directed neighbor pairs as DataFrames."""
