"""Operators over DataFrames of nodes, edges, chunks, vectors and logs."""
