"""Verse and corpus analytics on Spark DataFrames."""
