"""Vellumflow: word-processing packages to Markdown, and corpus operators, as Spark DataFrames."""
