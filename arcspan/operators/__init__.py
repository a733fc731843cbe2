"""Operators on DataFrames: each takes and returns DataFrames and declares a plan, no more."""
