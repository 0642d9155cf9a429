"""Verification, layout and evaluation operators on DataFrames."""
