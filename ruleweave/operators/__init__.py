"""Evaluation of rule programs with DataFrames."""
