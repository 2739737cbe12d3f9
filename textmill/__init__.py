"""Corpus-scale extractive text compression on Spark DataFrames."""
