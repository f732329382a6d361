"""Relational, graph and ranking operators over DataFrames."""
