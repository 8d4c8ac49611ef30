"""Validation: interpreter, expression compiler and the functions over DataFrames."""
